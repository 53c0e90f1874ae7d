"""Control-flow, data-flow and resolution passes."""

"""A JSON-RPC front end: tools by name over small inputs, computed by the engine's operators."""

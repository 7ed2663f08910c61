"""Column builders: stateless, codegen-friendly, one row in and one value out."""

"""Fixed values of the checks: thresholds, skipped directories, languages."""

MAX_BODY_LINES, MAX_NESTING, MAX_PARAMETERS = 40, 4, 5
BLOCK_LINES, BLOCK_BYTES, BLOCK_REPEATS = 6, 60, 3
MAX_FAN = 10
MAX_SUMMARY_LINES, MAX_DIAGRAM_NODES = 20, 150
CLAIM_SECONDS = 3600
SKIPPED_DIRECTORIES = (".git", "node_modules", "vendor", "target", "dist", "build", ".next")
JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
#: Styles of cycles in diagrams; fixed output format.
CYCLE_NODE, CYCLE_EDGE = "fill:#fee2e2,stroke:#dc2626,stroke-width:2px", "stroke:#dc2626,stroke-width:2px"
#: Go's predeclared scalar types, as the language lists them.
GO_PRIMITIVES = ("string", "bool", "byte", "rune", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64")
#: What a failure that the base revision has already says behind its message.
OLD_FAILURE = "(advisory: the base revision fails in the same way)"
#: What stands below advisories.
ADVISORY_NOTE = "If one of these findings is wrong, say so where checks are configured."
#: What to do about findings of an architecture checker.
RECOMMENDATIONS = {
    "import-cycles": "import-cycles: move what both sides need into a package of its own, or let one side depend on an interface.",
    "layering": "layering: put the import behind an interface that the upper layer owns, or move the code that needs it down.",
}

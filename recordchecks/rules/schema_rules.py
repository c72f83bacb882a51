"""Schema contract rules.

Fixed values: the coercion lattice (D16: keyed by Spark ``typeName()``,
``integer`` standing for int) and the message texts."""

# --- fixed values -----------------------------------------------------------
COMPATIBLE_TYPES = {
    "byte": ["short", "integer", "long", "float", "double", "decimal"],
    "short": ["integer", "long", "float", "double", "decimal"],
    "integer": ["long", "float", "double", "decimal"],
    "long": ["float", "double", "decimal"],
    "float": ["double", "decimal"],
    "string": ["varchar", "char"],
}
# --- end of fixed values ----------------------------------------------------


def coercion_pairs() -> list[tuple[str, str]]:
    """Pairs accepted in either direction."""
    out = set()
    for a, bs in COMPATIBLE_TYPES.items():
        for b in bs:
            out.add((a, b))
            out.add((b, a))
    return sorted(out)

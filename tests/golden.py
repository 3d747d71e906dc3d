"""Label counts that follow from published rates, to regenerate labelled rows, and the published rates."""

# Fixed values: (coefficient, FIGURATIVE, LITERAL, INCOHERENT) per series.
COUNTS = {
    "Idiom": (
        (-4.78, 157, 301, 42),
        (-3.59, 165, 309, 26),
        (-2.39, 152, 309, 39),
        (-1.2, 194, 288, 18),
        (0.0, 266, 218, 16),
        (1.2, 258, 218, 24),
        (2.39, 270, 208, 22),
        (3.59, 282, 193, 25),
        (4.78, 261, 217, 22),
    ),
    "Conventional Metaphor": (
        (-4.78, 73, 164, 13),
        (-3.59, 76, 165, 9),
        (-2.39, 73, 170, 7),
        (-1.2, 75, 170, 5),
        (0.0, 102, 137, 11),
        (1.2, 122, 118, 10),
        (2.39, 106, 130, 14),
        (3.59, 100, 137, 13),
        (4.78, 90, 139, 21),
    ),
    "Novel Metaphor": (
        (-4.78, 28, 91, 6),
        (-3.59, 25, 91, 9),
        (-2.39, 29, 90, 6),
        (-1.2, 25, 97, 3),
        (0.0, 28, 92, 5),
        (1.2, 32, 86, 7),
        (2.39, 36, 82, 7),
        (3.59, 50, 64, 11),
        (4.78, 42, 72, 11),
    ),
    "Simile": (
        (-4.78, 22, 93, 10),
        (-3.59, 35, 75, 15),
        (-2.39, 38, 69, 18),
        (-1.2, 39, 72, 14),
        (0.0, 53, 61, 11),
        (1.2, 50, 61, 14),
        (2.39, 44, 65, 16),
        (3.59, 34, 71, 20),
        (4.78, 47, 62, 16),
    ),
}

# Published literal and coherence rates by coefficient,
# (coefficient, idiom literal, figurative literal, idiom coherence, figurative coherence).
BY_CONDITION = (
    (-4.78, 0.602, 0.696, 0.916, 0.942),
    (-3.59, 0.618, 0.662, 0.948, 0.934),
    (-2.39, 0.618, 0.658, 0.922, 0.938),
    (-1.2, 0.576, 0.678, 0.964, 0.956),
    (0.0, 0.436, 0.58, 0.968, 0.946),
    (1.2, 0.436, 0.53, 0.952, 0.938),
    (2.39, 0.416, 0.554, 0.956, 0.926),
    (3.59, 0.386, 0.544, 0.95, 0.912),
    (4.78, 0.434, 0.546, 0.956, 0.904),
)

# Published deltas from coefficient 0.0 to -4.78.
DELTAS = {
    "idiom": 0.166,
    "figurative": 0.116,
    "Conventional Metaphor": 0.108,
    "Novel Metaphor": -0.008,
    "Simile": 0.256,
}

# Fixed values: (human, judge, rows) of the hand-labelled sample.
RATINGS = (
    ("FIGURATIVE", "FIGURATIVE", 26),
    ("LITERAL", "LITERAL", 38),
    ("FIGURATIVE", "LITERAL", 16),
    ("LITERAL", "FIGURATIVE", 5),
    ("FIGURATIVE", "INCOHERENT", 1),
)

LABELS = ("FIGURATIVE", "LITERAL", "INCOHERENT")


def labelled_rows(names):
    """(category, coefficient, label), one per counted row."""
    return [
        (name, coefficient, label)
        for name in names
        for coefficient, *counts in COUNTS[name]
        for label, n in zip(LABELS, counts)
        for _ in range(n)
    ]

# Published rates by category and coefficient (FIGURATIVE, LITERAL,
# INCOHERENT, coherence rate).
BY_CATEGORY = (
    ("Conventional Metaphor", -4.78, 0.292, 0.656, 0.052, 0.948),
    ("Conventional Metaphor", -3.59, 0.304, 0.66, 0.036, 0.964),
    ("Conventional Metaphor", -2.39, 0.292, 0.68, 0.028, 0.972),
    ("Conventional Metaphor", -1.2, 0.3, 0.68, 0.02, 0.98),
    ("Conventional Metaphor", 0.0, 0.408, 0.548, 0.044, 0.956),
    ("Conventional Metaphor", 1.2, 0.488, 0.472, 0.04, 0.96),
    ("Conventional Metaphor", 2.39, 0.424, 0.52, 0.056, 0.944),
    ("Conventional Metaphor", 3.59, 0.4, 0.548, 0.052, 0.948),
    ("Conventional Metaphor", 4.78, 0.36, 0.556, 0.084, 0.916),
    ("Novel Metaphor", -4.78, 0.224, 0.728, 0.048, 0.952),
    ("Novel Metaphor", -3.59, 0.2, 0.728, 0.072, 0.928),
    ("Novel Metaphor", -2.39, 0.232, 0.72, 0.048, 0.952),
    ("Novel Metaphor", -1.2, 0.2, 0.776, 0.024, 0.976),
    ("Novel Metaphor", 0.0, 0.224, 0.736, 0.04, 0.96),
    ("Novel Metaphor", 1.2, 0.256, 0.688, 0.056, 0.944),
    ("Novel Metaphor", 2.39, 0.288, 0.656, 0.056, 0.944),
    ("Novel Metaphor", 3.59, 0.4, 0.512, 0.088, 0.912),
    ("Novel Metaphor", 4.78, 0.336, 0.576, 0.088, 0.912),
    ("Simile", -4.78, 0.176, 0.744, 0.08, 0.92),
    ("Simile", -3.59, 0.28, 0.6, 0.12, 0.88),
    ("Simile", -2.39, 0.304, 0.552, 0.144, 0.856),
    ("Simile", -1.2, 0.312, 0.576, 0.112, 0.888),
    ("Simile", 0.0, 0.424, 0.488, 0.088, 0.912),
    ("Simile", 1.2, 0.4, 0.488, 0.112, 0.888),
    ("Simile", 2.39, 0.352, 0.52, 0.128, 0.872),
    ("Simile", 3.59, 0.272, 0.568, 0.16, 0.84),
    ("Simile", 4.78, 0.376, 0.496, 0.128, 0.872),
)

# Published rates of trusted rows by coefficient (FIGURATIVE, LITERAL, INCOHERENT,
# coherence rate), of 100 rows each.
TRUSTED = (
    (-4.78, 0.26, 0.7, 0.04, 0.96),
    (-3.59, 0.26, 0.69, 0.05, 0.95),
    (-2.39, 0.26, 0.7, 0.04, 0.96),
    (-1.2, 0.25, 0.73, 0.02, 0.98),
    (0.0, 0.31, 0.64, 0.05, 0.95),
    (1.2, 0.37, 0.55, 0.08, 0.92),
    (2.39, 0.38, 0.53, 0.09, 0.91),
    (3.59, 0.45, 0.49, 0.06, 0.94),
    (4.78, 0.34, 0.56, 0.1, 0.9),
)

# Published clusters, deltas and intervals. The labelled rows behind them are not
# published, and neither are the clusters' counts, so intervals can't be made again; points can.
INTERVALS = (
    ("Idiom", 20, 0.16599999999999998, 0.10799999999999998, 0.22600000000000003),
    ("Conventional Metaphor", 10, 0.10799999999999998, 0.05599999999999994, 0.15600000000000003),
    ("Novel Metaphor", 5, -0.008000000000000007, -0.15200000000000002, 0.136),
    ("Simile", 5, 0.256, 0.22399999999999998, 0.296),
)

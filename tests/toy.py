"""The hand-checked eight-vertex graph of FIXTURES.md."""

TOY = [(1, 2), (1, 3), (1, 4), (2, 3), (4, 5), (5, 6), (4, 6), (6, 7), (7, 8), (8, 8), (1, 2)]
TOY_LABELS = {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 1, 8: 2}

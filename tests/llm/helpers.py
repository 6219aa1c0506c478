"""Small tables with every awkward row, and brute-force versions."""

from __future__ import annotations

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i:02d}" for i in range(60)]


def words(lo: int, hi: int) -> str:
    return " ".join(WORDS[lo:hi])


def awkward(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, words(0, 40), "aa", "s1", 10),
        (2, words(0, 40), "aa", "s1", 10),
        (3, words(0, 39) + " other", "aa", None, None),
        (3, words(0, 39) + " other", "aa", None, None),
        (4, None, None, "s1", None),
        (5, "", "bb", "s2", 0),
        (6, "  \n", "bb", "s2", 3),
        (None, words(20, 60), "bb", "s2", 5),
        (None, None, None, None, None),
        (7, "one two", "aa", "s1", 7),
        (8, "one two", None, "s1", 7),
        (9, "€" * 70000 + words(0, 40), "bb", "s3", 9),
        (10, " ".join(WORDS) * 400, "aa", "s3", 9),
        (11, "12 34 !!", "aa", "s3", 9),
    ]
    clash = "digest string, row string, key string, file string, doc string, n int, h int, fold int, size int"
    more = ("x", "y", "z", "f", "d", 7, 8, 9, 10)
    return spark.createDataFrame([(*r, *more) for r in rows], f"{DOCS}, {clash}")


def empty(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)


def shingles(text: str | None) -> frozenset:
    found = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1 if found else 0)))


def jaccard_links(texts: list[str], threshold: float = 0.8) -> tuple[list[int], list[int]]:
    """Links of each distinct text, and the least number of the texts that links lead to."""
    sets = [shingles(t) for t in texts]
    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common: dict[int, int] = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(texts))]

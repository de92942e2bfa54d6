"""The pipeline's near-dedup against Jaccard similarity of sets of five-word shingles."""

import random

from test_text_operators import docs_of

from knnscore.llm import simhash


def words_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(n)]


def similarity(a, b):
    a, b = ({tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def edited(words, edits, seed):
    """`edits` words far enough apart, each replaced."""
    c = words[:]
    for k in range(edits):
        c[10 + k * (len(c) - 20) // edits] = f"new{seed}x{k}"
    return c


def kept(spark, texts):
    return {r.doc_id for r in simhash.keep_one_of_each(docs_of(spark, [" ".join(t) for t in texts])).collect()}


def test_less_similar_documents_stay(spark):
    base = [words_of(i, 260) for i in range(24)]
    copies = [edited(b, 7 + i % 3, i) for i, b in enumerate(base)]
    assert all(0.69 < similarity(b, c) < 0.8 for b, c in zip(base, copies, strict=True))
    assert kept(spark, base + copies) == set(range(48))


def block_edited(words, kind, n, seed):
    """A copy with n words appended, cut off, or replaced in one passage."""
    new = words_of(f"{kind}{seed}", n)
    return {"appended": words + new, "truncated": words[:-n], "replaced": words[:80] + new + words[80 + n :]}[kind]


def test_block_edits_are_found(spark):
    base, copies = [], []
    for i in range(150):
        kind, n = (("appended", 60), ("truncated", 48), ("replaced", 24))[i % 3]
        base.append(words_of(i, 260))
        copies.append(block_edited(base[-1], kind, n - i % 7, i))
    for i in range(20):  # few shingles: 8 and 10, or 9 and 11
        base.append(words_of(1000 + i, 12 + i % 2))
        copies.append(base[-1] + words_of(2000 + i, 2))
    assert all(0.8 <= similarity(b, c) <= 0.85 for b, c in zip(base, copies, strict=True))
    left = kept(spark, base + copies)
    assert len(left) == len(base) and {i % len(base) for i in left} == set(range(len(base)))

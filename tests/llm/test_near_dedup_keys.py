"""The pipeline's near-dedup finds its candidates by SimHash fingerprints and Golay keys."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_near_dedup import words_of
from test_text_operators import docs_of

from knnscore.llm import golay, simhash


def fingerprint(text):
    hashes = [int(h) for h in simhash.shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_close_fingerprints_are_candidates_without_samples(spark, monkeypatch):
    base = [words_of(i, 200) for i in range(40)]
    texts = [" ".join(w) for w in base + [[*w, "more"] for w in base]]
    prints = [fingerprint(t) for t in texts]
    apart = [bin(a ^ b).count("1") for a, b in zip(prints[:40], prints[40:], strict=True)]
    assert sum(d <= simhash.MAX_BITS for d in apart) > 20 and 0 < max(apart)
    made = simhash.shingle_prints
    monkeypatch.setattr(simhash, "shingle_prints", lambda *a: made(*a).withColumn("keys", F.slice("keys", 1, 0)))
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs_of(spark, texts)).collect()}
    for i, d in enumerate(apart):
        assert len(kept & {i, i + 40}) == (1 if d <= simhash.MAX_BITS else 2)


def test_sampled_fingerprints_are_majorities():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 64, (200, simhash.BAND_ROWS), dtype=np.uint64)
    hashes[:50, 1] = hashes[:50, 0]
    assert simhash.majorities(hashes).tolist() == [simhash.majority(h) for h in hashes]


def test_keys_of_samples_are_codewords():
    r = random.Random(2)
    words = [r.getrandbits(12) for _ in range(simhash.BANDS)]
    low = [next(v for v in range(w << golay.CHECK, (w + 1) << golay.CHECK) if golay.keys(np.array([v]))[0, 0] == w) for w in words]
    code = [next(v for v in range(w << golay.CHECK, (w + 1) << golay.CHECK) if golay._remainder(v) == 0) for w in words]
    fp = [(a << golay.BITS) | b for a, b in zip(code, low, strict=True)]
    for bits in (1, 2, 3):  # a codeword stays the nearest one for up to three bits
        near = [f ^ sum(1 << (golay.BITS + b) for b in r.sample(range(golay.BITS), bits)) for f in fp]
        a, b = (simhash.sample_keys(np.array([x], dtype=np.uint64)) for x in (fp, near))
        assert (a == b).all() and len(set(a[0].tolist())) == simhash.BANDS
    far = [f ^ 1 << 60 for f in fp]
    assert (simhash.sample_keys(np.array([far], dtype=np.uint64)) != a).all()

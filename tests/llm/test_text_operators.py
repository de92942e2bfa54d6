"""Chat formatting, fingerprints, exact dedup, mixing, personal data, language ID: SQL, brute force, edge cases."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from knnscore.llm import chat, exact_dedup, fingerprints, language, mixing, pii
from knnscore.llm.common import group_order, range_groups, tie_of
from knnscore.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, `_found` int"


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with helper columns."""
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None, "u", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_chat_round_trip(spark):
    T = chat.Template()
    texts = ["", None, "\\", "\\\\h", "### ", "</turn>\n", "\\### User: x</turn>", "a\nb", "#" * 9, "</tu</turn>rn>", "\\e\\h\\c:"]
    roles = ["system", "user", "assistant", "tool: x", None, "### ", "=x", "a\\c"]
    rows = [(i % 3, i, roles[i % len(roles)], t) for i, t in enumerate(texts * 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(df).select("conv_id", "formatted", chat.parse(F.col("formatted"), T).alias("t"), chat.loss_text(F.col("segments"), T).alias("loss")).collect():
        mine = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")


def test_chat_machine(spark):
    cases = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant", 4: "user user assistant", 5: "user", 6: "user assistant system"}
    rows = [(c, k, role, "x") for c, s in cases.items() for k, role in enumerate(s.split())]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 2), 5: (False, None), 6: (False, 3)}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def canon(t):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", folded).strip()


@pytest.mark.parametrize("group_rows", [1024, 3])
def test_fingerprints_by_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(fingerprints, "GROUP_ROWS", group_rows)
    texts = ["Hello  World", "hello world", "", None, "é", "é", "ﬁne", "fine", "x", "A\tB ", "a b", "long " * 3000, "same", "same", " same"]
    ids = [7, 3, 50, 9, 1000, 12, 13, 14, -5, 21, 22, 23, 900, 901, 902]
    got = {r.id: r for r in fingerprints.compare_with_next(docs_of(spark, texts, ids).repartition(3)).collect()}
    rows = sorted((i, t or "") for i, t in zip(ids, texts, strict=True))
    seen = {}
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(edited) == canon(t)), float(canon(nxt) == canon(t)))
        for x, f in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert seen.setdefault(canon(x), f) == f
    assert len(set(seen.values())) == len(seen)


def test_fingerprint_edges(spark):
    assert fingerprints.compare_with_next(docs_of(spark, [])).count() == 0
    one = fingerprints.compare_with_next(docs_of(spark, ["abcd"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    rep = fingerprints.compare_with_next(docs_of(spark, ["b", "a", None], [None, 1, 1])).collect()
    assert len(rep) == 3
    # equal digests of different texts get different fingerprints
    clash = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "k int, canon string").select(F.struct(F.col("k").cast("long").alias("h0"), F.lit(0).cast("long").alias("h1")).alias("digest"), "canon")
    v = fingerprints.variants(fingerprints.by_bytes(clash)).collect()
    assert sorted(r.variant for r in v) == [0, 1] and {r.digest.h0 for r in v} == {1}


def test_fingerprints_fold_case_in_full(spark):
    pairs = [("STRASSE", "straße"), ("ΟΔΟΣ", "οδοσ"), ("οδος", "ΟΔΟΣ"), ("ẞ", "ss"), ("ǰ", "J̌"), ("Ⅷ", "viii")]
    got = {r.id: r.fingerprint for r in fingerprints.document_fingerprints(docs_of(spark, [t for p in pairs for t in p])).collect()}
    for k, (a, b) in enumerate(pairs):
        assert canon(a) == canon(b) and got[2 * k] == got[2 * k + 1], (a, b)
    assert len(set(got.values())) == len({canon(a) for a, _ in pairs})


def test_range_groups_are_even(spark):
    def largest(ids, goal):
        df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
        rows = range_groups(df, df, goal, tie_of("id")).collect()
        by = sorted(rows, key=lambda r: (r.id is not None, r.id or 0))
        apart = [(a, b) for a, b in zip(by, by[1:], strict=False) if a.id != b.id]
        assert all(a.grp <= b.grp for a, b in apart)
        return max(Counter(r.grp for r in rows).values())

    islands = [(i << 33) + k for i in range(300) for k in range(200)]
    assert largest(islands, 100) <= 300
    assert largest([7] * 20_000 + list(range(40_000)), 500) <= 1500
    assert largest([None] * 20_000 + [7] * 20_000 + [k * k * k for k in range(20_000)], 500) <= 1500
    assert largest([1] * 60_000, 1000) <= 2000


def test_group_order(spark):
    groups = [-3, -1, 5, (1 << 53) + 2, (1 << 53) + (3 << 44), (2 << 53)]
    df = spark.createDataFrame([(g, k + 1) for k, g in enumerate(groups)], "grp long, n long")
    got = {r.grp: (r.follows, r.before) for r in group_order(df, F.col("n")).collect()}
    assert got == {g: (groups[(k + 1) % len(groups)], k * (k + 1) // 2) for k, g in enumerate(groups)}


def test_exact_dedup_edges(spark):
    texts = ["Same", "sAME", "É", "é", None, "", "x" * 100_000, "X" * 100_000, "rep", "rep"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    got = exact_dedup.exact_dedup(docs_of(spark, texts, ids)).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([
        (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 2, True), (9, 9, 2, False)])
    kept = exact_dedup.keep_one(docs_of(spark, texts, ids))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8, 9]
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs_of(spark, texts, ids), keep="min").collect()) == [1, 3, 4, 5, 7, 9]
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    nulls = exact_dedup.exact_dedup(docs_of(spark, ["a", "a"], [None, 3])).collect()
    assert {r.keep_id for r in nulls} == {3} and sum(r.kept for r in nulls) == 1


def water_fill(sizes, weights, total):
    goal, capped = sum(sizes) * total, set()
    while True:
        left = goal - sum(2 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [2 * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, x in enumerate(t) if x > 2 * sizes[i] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixing_by_iteration(spark):
    sources = ["b"] * 5 + ["a"] * 40 + [None] * 3 + ["é"] * 10 + ["Z"] * 2
    texts = ["w " * (1 + i * 7 % 50) for i in range(len(sources))]
    texts[3], texts[7] = None, ""
    df = docs_of(spark, texts, sources=sources)
    sizes = mixing.document_sizes(df).cache()
    got = mixing.mix(sizes).collect()
    names = ["Z", "a", "b", "é", None]
    per = [sum(len((t or "").split()) for t, s in zip(texts, sources, strict=True) if s == n) for n in names]
    want = dict(zip(names, water_fill(per, [3, 1, 2, 3, 1], 1.5), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[n] - want[n]) <= 1 for n in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mixing.document_sizes(df.repartition(5))).collect()))
    assert mixing.mix(mixing.document_sizes(docs_of(spark, []))).count() == 0
    assert mixing.mix(mixing.document_sizes(docs_of(spark, [None, ""]))).agg(F.sum("taken")).first()[0] == 0
    rep = mixing.repeat_documents(df)
    assert rep.columns == df.columns
    times = Counter(r.doc_id for r in rep.collect())
    assert max(times.values()) <= 2 and times[3] == 1


def test_mixing_ranges_do_not_matter(spark, monkeypatch):
    df = docs_of(spark, ["w " * (1 + i % 9) for i in range(60)], sources=["a", "b", "c"] * 20)
    sizes = mixing.document_sizes(df).cache()
    one = sorted(map(str, mixing.mix(sizes).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    assert sorted(map(str, mixing.mix(sizes).collect())) == one


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(60 * 7).select(F.array(F.floor(F.col("id") / 7), F.col("id") % 7).alias("v"))
    got = df.select(pii.feistel(F.col("v"), F.array(F.lit(60), F.lit(7)), F.lit("t"), "test key").alias("n")).collect()
    assert {tuple(r.n) for r in got} == {(a, b) for a in range(60) for b in range(7)}


def test_feistel_by_brute_force(spark):
    def plain(v, radices, kind, key):
        m = len(v) // 2
        halves, mods = [v[:m], v[m:]], [radices[:m], radices[m:]]
        for i in range(pii.ROUNDS):
            said = f"{key}|{kind}|{i}|{','.join(map(str, halves[1 - i % 2]))}"
            h = "".join(hashlib.sha512(f"{said}|{k}".encode()).hexdigest() for k in (0, 1))
            halves[i % 2] = [(x + int(h[8 * j : 8 * j + 8], 16)) % r for j, (x, r) in enumerate(zip(halves[i % 2], mods[i % 2], strict=True))]
        return halves[0] + halves[1]

    for v, r in (([1, 2, 3], [10, 256, 9999]), ([5, 1], [26, 26]), (list(range(9)), [26] * 9), ([0] * 64, [10] * 64)):
        arr = lambda a: F.array(*map(F.lit, a))
        got = spark.range(1).select(pii.feistel(arr(v), arr(r), F.lit("k"), "key").alias("n")).first().n
        assert got == plain(v, r, "k", "key")


def test_pii_formats(spark):
    text = "born 1984-02-29, 31/12/1999 or 31.12.1999; ssn 123-45-6789; card 4111 1111 1111 1111; ip 10.0.0.255; call +1 (017) 555-7713; mail A.b-c9@x.org. again 4111 1111 1111 1111"
    keep = "1999-02-30 2020-13-01 666-12-1234 4111-1111-1111-1112 300.1.1.1 1.2.3.4.5 12345 v2.0"
    out = pii.pseudonymize(docs_of(spark, [text, keep, None, "", "no digits", text + keep]), "test key")
    assert out.columns[:-1] == docs_of(spark, []).columns
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == (keep, None, "", "no digits")
    assert got[0].n_private == 9 and [got[i].n_private for i in (1, 2, 3, 4)] == [0] * 4
    new = got[0].text
    assert re.sub(r"[0-9a-z]", "x", new.split("ssn")[1]).count("x") == re.sub(r"[0-9a-z]", "x", text.split("ssn")[1]).count("x") or "ip" in new
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", new)
    assert len(set(cards)) == 1 and len(cards) == 2 and luhn_ok(cards[0]) and cards[0] not in text
    for old in ("1984-02-29", "31/12/1999", "31.12.1999", "123-45-6789", "10.0.0.255", "555-7713", "A.b-c9"):
        assert old not in new
    assert re.search(r"mail [A-Z]\.[a-z]-[a-z]\d@x\.org\.", new) and "+1 (" in new
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs_of(spark, [text]), key="other").collect()}[0]
    assert other != new
    assert pii.pseudonymize(docs_of(spark, []), "test key").count() == 0


def test_language(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    assert len(out) == len(rows)
    for r in rows:
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= out[r.doc_id].score <= 1
    held = [r for r in rows if out[r.doc_id].held_out and language.has_letter(r.text)]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    train = [("the of and with this that", "en"), ("der die das und nicht ist", "de")] * 30
    model = language.train(train)
    df = docs_of(spark, [None, "", "12 !?", "the and of", "und das ist " * 50_000, "日本"])
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(df, model).collect()}
    assert [got[i] for i in (0, 1, 2)] == [("und", True)] * 3
    assert got[3] == ("en", False) and got[4] == ("de", False) and got[5][0] in ("en", "de")
    assert language.predict(docs_of(spark, []), model).count() == 0
    assert language.train([]).predict("the") == ("und", 0.0, True)
    no_labels = docs_of(spark, ["a", "b"]).withColumn("lang", F.lit(None).cast("string"))
    assert language.sample(no_labels) == [] and language.keep_known(no_labels).count() == 0
    assert language.keep_known(docs_of(spark, ["the and of"] * 30 + ["..."])).columns == df.columns
    blocks = list(language.feature_blocks("ab " * (language.BLOCK // 2)))
    assert len(blocks) > 1

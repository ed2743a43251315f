import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvlake.llm import common, minhash, pii, topk_search, toxicity

from .conftest import COLUMNS, ODD
from .test_dedup import brute_components, varied


def brute_top(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * x) for x in v]
            best[i] = min(best.get(i, q), q)
    out = []
    for i, q in best.items():
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in best.items() if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(seed, n, dim):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice((rnd.gauss(0, 1), 0.5, -1.0)) for _ in range(dim)]) for i in range(n)]
    rows += [(i + n, [0.25] * dim) for i in range(30)]  # ties
    return rows


@pytest.mark.parametrize("rows", [
    vectors(1, 200, 8), vectors(2, 50, 1), [], [(0, [1.0, 2.0])], [(0, []), (20, []), (1, [])],
    vectors(3, 30, 4) + [(200, None), (201, [1.0, None, 2.0, 1.0]), (220, [math.nan] * 4), (240, [math.inf] * 4), (None, [1.0] * 4), (20, [9.0] * 4), (20, [9.0] * 4), (260, [1.0] * 3)],
])
def test_top(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = topk_search.op3_topk_search(spark, str(tmp_path)).collect()
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found)) == brute_top(single, 20)


def test_scores_beyond_doubles(spark):
    rows = [(0, [2**30, 3]), (1, [2**31 + 1, 7]), (2, [2**31 + 1, 6]), (3, [-(2**31), 0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    found = topk_search.search(df.where("vec_id = 0"), df, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 2**30 * (2**31 + 1) + 21), (2, 2**30 * (2**31 + 1) + 18)]


# Private data

def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", s))):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def keyed(key, tag, *parts):
    import hashlib

    return int(hashlib.sha256("|".join([key, tag, *map(str, parts), key]).encode()).hexdigest()[:15], 16)


def brute_digits(x, key, tag):
    n, left = len(x), len(x) // 2
    high, low = int(x[:left]), int(x[left:])
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            low = (low + keyed(key, tag, i, n, high)) % 10 ** (n - left)
        else:
            high = (high + keyed(key, tag, i, n, low)) % 10**left
    return str(high).zfill(left) + str(low).zfill(n - left)


VALUES = {
    "card": (["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "340000000000009"], ["4111111111111112", "9807915762804490", "x4111111111111111", "0000000000000000"]),
    "email": (["ana.68@mail7.example.com", "lérépa.03@mail7.example.com", "A_b-c+9@x.co.uk"], ["@mail.example.com", "a@b", "a b@"]),
    "phone": (["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+44 20 7946 0958"], ["555-0100", "+1", "12 34 56"]),
    "ip": (["97.51.17.173", "255.0.0.1"], ["300.1.1.1", "1.2.3", "1.2.3.4.5"]),
    "date": (["2024-02-29", "31/12/1999", "12/31/1999", "01.05.2003", "1900/01/01", "2100-01-02"], ["2023-02-29", "32/13/1999", "1899-12-31", "2100-01-03"]),
    "ssn": (["123-45-6789", "899-99-9999", "001-01-0001", "667-01-0001"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]),
    "iban": (["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["GB82WEST12345698765431", "DE00 3704 0044 0532 0130 00"]),
    "secret": (['token = "9807f15762804490abcdef0123456789abcdef01"', 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "api_key: Zx81_abcdefghij0123"], ["token = short1", "9807f15762804490abcdef0123456789abcdef01"]),
}


def test_each_kind(spark, docs):
    rows = [(i, f"Then {v}, or so.") for i, v in enumerate(v for good, _ in VALUES.values() for v in good)]
    kinds = [k for k, (good, _) in VALUES.items() for _ in good]
    found = {r.doc_id: r for r in pii.pseudonymised(docs(rows)).collect()}
    for i, text in rows:
        r, old = found[i], text[5:-8]
        new = r.text[5:-8]
        assert r.private_kinds == [kinds[i]] and r.n_private == 1 and new != old and (r.text[:5], r.text[-8:]) == (text[:5], text[-8:])
        if kinds[i] not in ("ip", "secret"):
            assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old)))
        if kinds[i] == "card":
            digits = re.sub(r"\D", "", old)
            assert luhn(new) and re.sub(r"\D", "", new)[:-1] == brute_digits(digits[:-1], pii.KEY, "card")
        if kinds[i] == "phone":
            cut = len(re.match(r"\+\d{1,3}|", old).group())
            assert re.sub(r"\D", "", new[cut:]) == brute_digits(re.sub(r"\D", "", old[cut:]), pii.KEY, "phone")
        if kinds[i] == "ip":
            assert all(0 <= int(x) < 256 for x in new.split(".")) and len(new.split(".")) == 4
        if kinds[i] == "secret":
            assert len(new) == len(old) and re.fullmatch("[0-9a-f]{40}|[0-9A-F]{40}|[A-Za-z0-9_]+", re.split("[\"' ]+", new.strip('"'))[-1])
    # What comes out is found as the same kind again.
    again = pii.pseudonymised(docs([(i, r.text) for i, r in found.items()])).collect()
    assert all(r.private_kinds == found[r.doc_id].private_kinds for r in again)


def test_what_does_not_validate_stays(spark, docs):
    rows = [(i, f"Then {v}, or so.") for i, v in enumerate(v for _, bad in VALUES.values() for v in bad)] + ODD
    assert all(r.n_private == 0 for r in pii.pseudonymised(docs(rows)).collect())
    assert sorted(((r.doc_id, r.text) for r in pii.pseudonymised(docs(rows)).collect()), key=str) == sorted(rows, key=str)


def test_values_side_by_side(spark, docs):
    values = ["+1 (826) 555-4081", "190.137.223.204", "4111111111111111", "97.51.17.173", "4111 1111 1111 1111", "10.0.0.1", "123-45-6789", "2024-02-29", "ana.68@mail7.example.com"]
    kinds = ["phone", "ip", "card", "ip", "card", "ip", "ssn", "date", "email"]
    made = pii.pseudonymised(docs([(1, " ".join(values)), (2, " ".join(reversed(values)))])).orderBy("doc_id").collect()
    assert made[0].private_kinds == kinds and made[1].private_kinds == kinds[::-1]
    assert not any(v in r.text for r in made for v in values)
    both = pii.pseudonymised(docs([(1, "+44 20 7946 0958 123-45-6789")])).first().text
    assert "+44 20 7946 0958" not in both and "123-45-6789" not in both


def test_ibans_end_where_they_do(spark, docs):
    ibans = ["AT611904300234573201", "ES9121000418450200051332", "BE68539007547034", "BE68 5390 0754 7034", "SE4550000000058398257466", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"]
    behind = {" EUR 500": [], " BIC": [], " 123-45-6789": ["ssn"], " 97.51.17.173": ["ip"], " 4111 1111 1111 1111": ["card"], " 12": [], ".": []}
    cases = [(f"To {i}{b}", ["iban", *kinds], [i]) for i in ibans for b, kinds in behind.items()]
    cases += [(f"{a} {b}, {a}", ["iban"] * 3, [a, b]) for a in ibans for b in ibans]
    cases += [(f"{a} 4111 1111 1111 1111", ["card"], ["4111 1111"]) for a in ("PO12", "ES12 0000 0000", "GB12", "DE12 ABCD", "1234", "1234 5678")]
    cases += [("x AT61 AT611904300234573201 BIC", ["iban"], ["AT611904300234573201"]), ("token = AT611904300234573201-ab", ["secret"], ["AT6119"]), ("AT611904300234573201@x.com", ["email"], ["AT6119"])]
    found = {r.doc_id: r for r in pii.pseudonymised(docs([(i, t) for i, (t, _, _) in enumerate(cases)])).collect()}
    for i, (text, kinds, gone) in enumerate(cases):
        assert found[i].private_kinds == kinds and not any(g in found[i].text for g in gone), text
    same = pii.pseudonymised(docs([(1, "AT611904300234573201 EUR"), (2, "AT61 1904 3002 3457 3201, EUR")])).orderBy("doc_id").collect()
    assert same[0].text[:20] == same[1].text.replace(" ", "")[:20]


def test_whole_credentials(spark, docs):
    rnd = random.Random(7)
    some = lambda n, letters="abcdefghijABCDEFGHIJ0123456789": "".join(rnd.choice(letters) for _ in range(n))
    values = [some(400), some(400, "0123456789abcdef"), some(300, "abcdef") + some(100, "0123456789"), some(60_000), f"eyJhbGciOiJIUzI1NiJ9.{some(90)}.{some(43)}", some(40) + "==", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    cases = [("token = ", v) for v in values] + [(f"{name}{sep}", values[-1]) for name in ("aws_secret_access_key", "secret_key", "private_key", "privateKey", "X-API-Key", "key") for sep in (" = ", ": ", "=", '": "', " => ")]
    cases += [("password: ", "Tr0ub4dor&3"), ("passwd=", "p4ss.w(rd!xyz"), ("password: ", "abcdefghij0123456789")]
    made = {r.doc_id: r for r in pii.pseudonymised(docs([(i, f"So {a}{v}. Then") for i, (a, v) in enumerate(cases)])).collect()}
    for i, (label, old) in enumerate(cases):
        r, at = made[i], len(f"So {label}")
        new = r.text[at:-6]
        assert r.private_kinds == ["secret"] and r.text[:at] == f"So {label}" and r.text[-6:] == ". Then" and len(new) == len(old), old[:50]
        # A letter or digit stays by chance only: no long part of the value is left.
        for k in range(0, min(len(old), 2000) - 7):
            assert old[k : k + 8] != new[k : k + 8], (old[:50], k)
    left = ["token = short1", "password: abc1", "password: without any digit", "key: abc def 1"]
    assert all(r.n_private == 0 for r in pii.pseudonymised(docs(list(enumerate(left)))).collect())


def test_addresses_in_any_alphabet(spark, docs):
    import unicodedata

    names = ["иван", "Иван.Петров", "νίκος", "محمد", "山田太郎", "김철수", "דוד", "éèêë", "ß", "ოთარ", "иван.1", "李1", "٣٤٥", "łéñ.é"]
    made = {r.doc_id: r for r in pii.pseudonymised(docs([(i, f"To {n}@x.com, {n}@y.org.") for i, n in enumerate(names)] + [(99, "To +.-@x.com.")])).collect()}
    kept = 0
    for i, name in enumerate(names):
        new = re.findall(r"[ ](\S+)@", made[i].text)
        assert new[0] == new[1] != name and made[i].private_kinds == ["email"] * 2 and len(new[0]) == len(name), name
        assert [unicodedata.category(c) for c in new[0]] == [unicodedata.category(c) for c in name], name
        kept += sum(a == b for a, b in zip(new[0], name, strict=True) if b not in ".1")
    assert kept * 8 <= sum(map(len, names))  # by chance only
    assert made[99].n_private == 0 and made[99].text == "To +.-@x.com."
    letters = [chr(c) for c in [*range(0xC0, 0x180), *range(0x400, 0x460)] if chr(c).isalpha()]
    pairs = spark.createDataFrame([(a + b,) for a in letters[:60] for b in letters], "x string")
    assert pairs.select(pii.permuted_text(F.col("x"), "k", "t").alias("p")).agg(F.countDistinct("p")).first()[0] == pairs.count()


def test_other_groupings(spark, docs):
    cards = ["3056 930902 5904", "3056-930902-5904", "6304 0000 0000 0000 000", "4222 222 222 222", "4222-2222-2222-2", "4111 1111 1111 1111"]
    linked = [("+12125550100", "+1 212 555 0100"), ("+442079460958", "+44 20 7946 0958"), ("+353861234567", "+353 86 123 4567")]
    dates = ["2024-02-29T10:00:00", "2024-02-29T1000Z", "2024-02-29"]
    rows = [*cards, "4111 1111 1111 1111 124", *dates, *(x for pair in linked for x in pair)]
    made = [(r.text[3:-1], r.private_kinds) for r in pii.pseudonymised(docs([(i, f"On {t}.") for i, t in enumerate(rows)])).orderBy("doc_id").collect()]
    for old, (new, kinds) in zip(rows[: len(cards)], made, strict=False):
        assert kinds == ["card"] and luhn(new) and new != old and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", old), old
    assert made[len(cards)] == (made[len(cards) - 1][0] + " 124", ["card"])
    a, b, c = made[len(cards) + 1 : len(cards) + 4]
    assert a[1] == ["date"] and c[0] != dates[2] and a[0] == c[0] + "T10:00:00" and b[0] == c[0] + "T1000Z"
    phones = [re.sub(r"\D", "", new) for new, _ in made[len(cards) + 4 :]]
    assert phones[::2] == phones[1::2] and all(x != re.sub(r"\D", "", pair[0]) for x, pair in zip(phones[::2], linked, strict=True))
    short = pii.pseudonymised(docs([(1, "call +35312345")])).first()
    assert short.private_kinds == ["phone"]


def test_links_across_documents(spark, docs):
    a, b = "card 4111 1111 1111 1111", "4111111111111111 and 4111111111111111, 4242424242424242"
    x, y = (r.text for r in pii.pseudonymised(docs([(1, a), (2, b)])).orderBy("doc_id").collect())
    first = re.findall(r"\d{16}", x.replace(" ", ""))[0]
    assert re.findall(r"\d{16}", y)[:2] == [first, first] != re.findall(r"\d{16}", y)[1:]
    other = pii.pseudonymised(docs([(1, a)]), key="another").first().text
    assert other != x


def test_one_to_one(spark):
    n = 319 * 229
    df = spark.range(n).select(pii.permuted_below(F.col("id"), (319, 229), "k", "t").alias("p"))
    assert df.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()[:] == (n, 0, n - 1)
    df = spark.range(100_000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 5, "0"), "k", "t").alias("p"))
    assert df.agg(F.countDistinct("p"), F.min(F.length("p"))).first()[:] == (100_000, 5)
    df = spark.range(26**3).select(pii.permuted_text(F.concat(*(F.char(97 + F.floor(F.col("id") / 26**i) % 26) for i in range(3))), "k", "t").alias("p"))
    assert df.agg(F.countDistinct("p")).first()[0] == 26**3
    df = spark.range(16**3).select(pii.permuted_hex(F.lower(F.lpad(F.hex("id"), 3, "0")), "k", "t").alias("p"))
    assert df.agg(F.countDistinct("p")).first()[0] == 16**3


def test_pii_columns(spark, docs):
    df = docs([(1, "a 97.51.17.173 b")]).withColumn("_found", F.lit(1)).withColumn("n_private", F.lit("clash"))
    made = pii.pseudonymised(df)
    assert made.columns.count("n_private") == 1 and made.first().n_private == 1 and "_found" in made.columns
    assert pii.pseudonymised(docs([])).count() == 0


# Toxicity

def toxic_corpus(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(("an", "the", "re", "on", "st", "in")) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        sentences = [[word() for _ in range(rnd.randrange(3, 12))] for _ in range(rnd.randrange(1, 9))]
        bad = i % 5 == 0
        if bad:
            for s in rnd.sample(sentences, min(2, len(sentences))):
                s.insert(rnd.randrange(len(s)), rnd.choice(("idiot", "scum", "moron")))
                s.insert(rnd.randrange(len(s)), rnd.choice(("idiot", "scum", "moron")))
        rows.append((i, " ".join(" ".join(s).capitalize() + "." for s in sentences)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, sf_dir):
    rows, labels = toxic_corpus(900)
    found = toxicity.op9_toxicity(spark, sf_dir(rows + [(None, "You idiot."), (2000, None), (2001, ""), (2002, "idiot scum " * 100_000)], labels + [(None, 1, 1), (3000, 1, None), (3001, 1, 1)])).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 904 and by_id[2000].score == by_id[2001].score == 0 and by_id[2002].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir, docs, tmp_path):
    rows, labels = toxic_corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    made = [toxicity.learn(docs(rows), spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")) for x in (labels, turned)]
    assert (made[0].weights == made[1].weights).all() and made[0].bias == made[1].bias


def test_without_labels(spark, sf_dir):
    assert {r.score for r in toxicity.op9_toxicity(spark, sf_dir(ODD)).collect()} == {0.0}


def test_locating(spark, docs):
    rows, labels = toxic_corpus(600)
    model = toxicity.train([t.lower().encode() for _, t in rows], [t for _, _, t in labels])
    text = "The rest on an. You idiot and scum! Éan thest inre."
    found = toxicity.locate(docs([(1, text), (2, None), (3, "The an on.")]), model).collect()
    assert [(r.doc_id, r.sentence, text.encode()[r.start : r.end].decode()) for r in found] == [(1, "You idiot and scum", "You idiot and scum")]


def test_noisy_or():
    model = toxicity.Model(np.zeros(toxicity.FEATURES, np.float32), -2.0)
    at = toxicity.sentences([b"bad"]).features[0]
    model.weights[np.unique(at)] = 3.0 / len(at)
    w = float(model.weights[at].sum())
    p = lambda z: 1 / (1 + math.exp(-z))
    expected = 1 - (1 - p(-2 + w)) * (1 - p(-2)) * (1 - p(-2 + 2 * w))
    assert 1 - math.exp(-model.surprise([b"bad. good one! bad\nbad bad"])[0]) == pytest.approx(1 - (1 - expected) * (1 - p(-2 + w)))
    long = b"good one. " * 300_000
    assert sum(model.surprise([part])[0] for part in toxicity._segments(long)) == pytest.approx(300_000 * math.log1p(math.exp(-2)))


# Pipeline

def test_pipeline(spark, sf_dir):
    rows, labels = toxic_corpus(300)
    rows += [(1000 + i, t) for i, t in varied(9, 60, 2)] + [(2000 + i, t) for i, t in rows[:40]] + ODD + [(3000, "Write to ana.68@mail7.example.com now")]
    path = sf_dir(rows, labels)
    docs, kept = common.table(spark, path, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, path), "test-stage")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if name == "toxicity":
            model = toxicity.learn(before, common.table(spark, path, "labels"))
            scores = [toxicity.Model.surprise(model, [(t or "").lower().encode()])[0] for _, t in rows]
            assert sorted(((r.doc_id, r.text) for r in kept[name]), key=str) == sorted(((i, t) for (i, t), s in zip(rows, scores, strict=True) if -math.expm1(-s) < 0.7), key=str)
        if name == "exact dedup":
            best = {}
            for r in kept["toxicity"]:
                best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept[name]) == sorted(best.items())
        if name == "near dedup":
            inputs = [(r.doc_id, r.text) for r in kept["exact dedup"]]
            assert {r.doc_id for r in kept[name]} == {i for i, _, _, k in brute_components(inputs, 5, 80) if k}
        if name == "pii":
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in kept["near dedup"]}
            assert not any("ana.68@" in (r.text or "") for r in kept[name]) and all(r.n_chars == len(r.text or "") or r.text is None for r in kept[name])
        if name == "packing":
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in kept["pii"]}
    assert minhash and sorted(map(str, corpus_pipeline.run(spark, path).select("doc_id", "piece", "ids_crc32").collect())) == sorted(str(r) for r in docs.select("doc_id", "piece", "ids_crc32").collect())

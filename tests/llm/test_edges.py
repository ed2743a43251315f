"""Long texts, clashing columns, empty tables, hot keys, and what is left in the shared folder."""

import glob
import hashlib
import math
import random
import re
from functools import partial
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvlake.llm import bpe, common, exact_dedup, minhash, packing, pii, queries, sentencepiece_codec, substring_dedup, token_counts, token_output, topk_search, toxicity

from .conftest import ODD
from .test_dedup import brute_components, brute_windows, varied
from .test_search_and_labels import brute_digits, brute_top, keyed, toxic_corpus, vectors
from .test_tokens import crc, ids_of

# Shared folder


def folders(spark):
    return set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/kvlake/*"))


@pytest.mark.parametrize("name", queries.queries())
def test_queries_leave_their_result_only(spark, tmp_path, docs, name):
    rows, labels = toxic_corpus(60)
    docs(rows + [(i + 100, t) for i, t in rows[:9]]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vectors(4, 40, 4)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = folders(spark)
    found = queries.queries()[name](spark, str(tmp_path))
    assert found.count() > 0 and len(folders(spark) - before) <= 1


def test_pipeline_leaves_its_result_only(spark, sf_dir):
    rows, labels = toxic_corpus(60)
    before = folders(spark)
    assert corpus_pipeline.run(spark, sf_dir(rows, labels)).count() > 0 and len(folders(spark) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    # conf is a dict here: get() finds nothing, and set() isn't there.
    with pytest.raises(AttributeError):
        common.shared_dir(session("local[4]"))


def test_small_inputs_are_dealt_out(spark, sf_dir, monkeypatch):
    table = common.table(spark, sf_dir(ODD), "documents").coalesce(1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan(common.spread(table)) and common.spread(table).count() == len(ODD)
    monkeypatch.setattr(common, "SPREAD_BYTES", 1)
    assert "Exchange" not in plan(common.spread(table))


# Empty tables and clashing columns


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op4_pii", "op6_packing", "op8_token_counts", "op9_toxicity", "op10_token_output"])
def test_without_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir([])).count() == 0


def test_pipeline_without_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir([])).count() == 0


def test_pipeline_with_other_columns(spark, docs):
    """Stages carry columns that have the names of their own helpers and results."""
    rows, labels = toxic_corpus(40)
    names = ["score", "n_private", "private_kinds", "_scored", "_id", "_hash", "_rest", "_digest", "text_hash", "print", "component_id", "kept", "N", "toxic"]
    table = docs([*rows, (900, "Write to ana.68@mail7.example.com now"), (901, None)])
    for n in names:
        table = table.withColumn(n, F.concat(F.lit(n), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, table = table, common.written(stage(spark, table, ""), "clash") if name != "toxicity" else table
        assert table.columns == before.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in table.collect() for n in names), name
    model = toxicity.train([t.lower().encode() for _, t in rows], [t for _, _, t in labels])
    scored = toxicity.score(table, model)
    assert scored.columns == ["_score" if c == "score" else c for c in table.columns] + ["score"] and all(r["_score"] == f"score{r.doc_id}" for r in scored.collect())
    packed = corpus_pipeline.packed(spark, table, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in table.collect()}


def test_results_beside_columns_of_their_names(spark, docs):
    df = docs([(1, "a 97.51.17.173 b")]).withColumn("N_PRIVATE", F.lit("mine")).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("mine"))
    made = pii.pseudonymised(df).first()
    assert made["_N_PRIVATE"] == "mine" and made["n_private"] == 1
    model = sentencepiece_codec.model_path()
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, model=model), model=model).first()
    assert back["_ids"] == back["_decoded"] == "mine" and back["decoded"] == "a 97.51.17.173 b"


# Toxicity


def random_text(rnd, n):
    return "".join(rnd.choice(["word", "idiot", "a", "été", " ", " ", " ", ". ", "\n", ".", "!? ", "İ "]) for _ in range(n))


@pytest.mark.parametrize("chunk", [1, 7, 60, 900])
def test_parts_of_texts_change_nothing(monkeypatch, chunk):
    rnd, r = random.Random(chunk), np.random.default_rng(1)
    model = toxicity.Model(np.zeros(toxicity.FEATURES, np.float32), -4.0)
    model.weights[r.integers(0, toxicity.FEATURES, 200_000)] = r.random(200_000)
    texts = [random_text(rnd, rnd.randrange(300)).lower().encode() for _ in range(50)] + [b"", b"...", b"x" * 5000, b"no end " * 900, b" " * 2000 + b"a"]
    labels = np.arange(len(texts)) % 2.0
    flat = lambda: [x for part in model.scored(texts) for x in zip(*(c.tolist() for c in part[:3]), strict=True)]
    whole = model.surprise(texts), flat(), toxicity._uses(texts, model.weights > 0.5), toxicity._telling(texts, labels)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", chunk)
    assert model.surprise(texts) == pytest.approx(whole[0]) and flat() == whole[1]
    assert all((a == b).all() for a, b in zip(toxicity._uses(texts, model.weights > 0.5), whole[2], strict=True)) and (toxicity._telling(texts, labels) == whole[3]).all()


def brute_score(model, text):
    """The noisy-or in plain Python, sentence by sentence and word by word."""
    rest = 0.0
    for sentence in re.split(rb"[.!?\n]", text.lower().encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        if words:
            z = model.bias + sum(float(w) for word in words for w in model.weights[toxicity.sentences([word]).features[0]])
            rest += math.log1p(math.exp(-abs(z))) + max(z, 0)
    return 1 - math.exp(-rest)


def test_scores_against_plain_python(spark, sf_dir, docs):
    rows, labels = toxic_corpus(400)
    rows += [(5000 + i, random_text(random.Random(i), 80)) for i in range(30)] + [(9000 + n, t) for n, (_, t) in enumerate(ODD[:7])]
    path = sf_dir(rows, labels)
    model = toxicity.learn(common.table(spark, path, "documents"), common.table(spark, path, "labels"))
    # Learnt again by hand: the rows that may be learnt from, in the order of the hashes of their ids.
    order = [r.i for r in spark.createDataFrame([(i,) for i, _, _ in labels], "i bigint").where(~toxicity.held_out(F.col("i"))).orderBy(F.xxhash64("i"), "i").collect()]
    texts, truth = dict(rows[:400]), {i: t for i, _, t in labels}
    again = toxicity.train([texts[i].lower().encode() for i in order], [truth[i] for i in order])
    assert (again.weights == model.weights).all() and again.bias == model.bias and (model.weights > 0).any()
    found = toxicity.op9_toxicity(spark, path).collect()
    expected = sorted((str(i), brute_score(model, t or "")) for i, t in rows)
    assert [i for i, _ in expected] == [i for i, _ in sorted((str(r.doc_id), r.score) for r in found)]
    assert [s for _, s in sorted((str(r.doc_id), r.score) for r in found)] == pytest.approx([s for _, s in expected], abs=1e-9)


def test_a_sentence_over_a_chunk(spark, docs):
    model = toxicity.Model(np.zeros(toxicity.FEATURES, np.float32), -4.0)
    long = "word " * 600_000
    found = toxicity.score(docs([(1, long), (2, "word"), (3, long + ". word")]), model).orderBy("doc_id").collect()
    p = 1 / (1 + math.exp(4))
    assert [r.score for r in found] == pytest.approx([p, p, 1 - (1 - p) ** 2])


def test_locating_in_moved_texts(spark, docs):
    """Letters whose small forms are longer, and sentences that go on over parts."""
    rows, labels = toxic_corpus(600)
    model = toxicity.train([t.lower().encode() for _, t in rows], [t for _, _, t in labels])
    text = "İİ the on. You idiot and İ scum! Then."
    found = toxicity.locate(docs([(1, text)]), model).collect()
    assert [r.sentence for r in found] == ["You idiot and İ scum"] and text.encode()[found[0].start : found[0].end].decode() == found[0].sentence


# Tokens

BLANKS = [" " * 2_000_000, "a" + "\n" * 1_200_000 + "b", " \t" * 600_000 + "word", "x " + " " * 1_100_000 + "1" + "\u3000" * 1_050_000, "end" + "\xa0" * 100_000]


def test_long_blanks_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.byte_vocabulary())
    library.encode_special_tokens = True
    ours = bpe.ByteEncoder(bpe.byte_vocabulary())
    for t in BLANKS:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_runs_of_any_length_are_cut_alike(monkeypatch):
    ours, rnd = bpe.ByteEncoder(bpe.byte_vocabulary()), random.Random(3)
    texts = ["".join(rnd.choice([" ", "\n", "\t", "\x85", "\u2003", "a", "'s", "7", "é", "."]) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    plain = [ours.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG_BLANKS", 0)
    monkeypatch.setattr(bpe, "BLANKS", re.compile(bpe.BLANKS.pattern.replace("{100000,}", "{2,}")))
    assert [ours.encode(t) for t in texts] == plain


def test_long_blanks_in_queries(spark, sf_dir):
    rows, encode = list(enumerate(BLANKS)), ids_of(bpe.byte_vocabulary())
    path, start, expected = sf_dir(rows), 0, []
    for i, t in rows:
        ids = encode(t)
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_output.op10_token_output(spark, path).collect())) == expected
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.op8_token_counts(spark, path).collect()) == [(i, n - 1) for i, _, n, _ in expected]


def test_starts_are_those_of_the_files(spark, sf_dir, tmp_path):
    rnd = random.Random(6)
    rows = [(i // 6, "word " * rnd.randrange(40)) for i in range(60)] + [(None, "a"), (None, "b b")]
    path = sf_dir(rows)
    found = token_output.op10_token_output(spark, path).collect()
    out = f"{tmp_path}/ids"
    token_output.write_ids(common.table(spark, path, "documents"), out, vocabulary=bpe.byte_vocabulary())
    held = token_output.read_ids(spark, out).orderBy("part", "row").collect()
    start, expected = 0, []
    for r in held:
        expected.append((r.doc_id, start, len(r.ids), crc(r.ids)))
        start += len(r.ids)
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    ids = [-1 if r.doc_id is None else r.doc_id for r in held]
    assert ids == sorted(ids) and len(rows) == len(held)


def test_packing_is_certified(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rows = [(i, "word " * (37 * i % 2500)) for i in range(200)]
    packed = packing.op6_packing(spark, sf_dir(rows))
    lengths = np.asarray([r.length for r in packed.collect()])
    used, bound = packing.certificate(packed)
    assert bound == packing.lower_bound(lengths, 2048) <= used == packed.select("sequence_id").distinct().count() <= 1.02 * bound
    whole = spark.createDataFrame([(i, i, 0, 0, 1024, i) for i in range(100)], packing.PIECE)
    made = packing.pack(common.written(whole, "test-pieces"))
    assert packing.certificate(made) == (50, 50) and made.where("certified").count() == 100


# Private data


def brute_below(x, halves, key, tag):
    a, b = halves
    high, low = divmod(x, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            low = (low + keyed(key, tag, i, high)) % b
        else:
            high = (high + keyed(key, tag, i, low)) % a
    return high * b + low


def brute_text(x, key, tag):
    def moved(half, other, i):
        other = hashlib.sha256(other.encode()).hexdigest() if len(other) > 128 else other
        out = ""
        for j, c in enumerate(half):
            first, n = next(((f, n) for f, n in ((48, 10), (97, 26), (65, 26)) if f <= ord(c) < f + n), (0, 0))
            out += chr((ord(c) - first + keyed(key, tag, i, j, other)) % n + first) if n else c
        return out

    high, low = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(pii.ROUNDS):
        high, low = (high, moved(low, high, i)) if i % 2 == 0 else (moved(high, low, i), low)
    return high + low


def brute_hex(x, key, tag):
    def moved(half, other, i):
        stream = "".join(hashlib.sha256("|".join([key, tag, str(i), str(k), other, key]).encode()).hexdigest() for k in range(2))
        return "".join("0123456789abcdef"[(int(c, 16) + int(stream[j % 128], 16)) % 16] for j, c in enumerate(half))

    high, low = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(pii.ROUNDS):
        high, low = (high, moved(low, high, i)) if i % 2 == 0 else (moved(high, low, i), low)
    return high + low


def brute_luhn(body):
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def test_op4_against_plain_python(spark, sf_dir):
    """The registered query: every kind by a Feistel network of plain Python, in texts of all lengths."""
    from datetime import date, timedelta

    key, filler = pii.KEY, "lorem ipsum dolor " * 3000
    token, password, long_hex = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.c2lnbmF0dXJl", "Tr0ub4dor&3", "9807f15762804490abcdef0123456789" * 60

    def day(text, form):
        first = date.fromisoformat(pii.FIRST_DAY)
        return (first + timedelta(days=brute_below((date.fromisoformat(text) - first).days, pii.DAYS, key, "date"))).strftime(form)

    def ip(text):
        n = brute_below(int.from_bytes(map(int, text.split("."))), (65536, 65536), key, "ip")
        return ".".join(map(str, n.to_bytes(4)))

    def ssn(text):
        area, group, serial = map(int, text.split("-"))
        n = brute_below(((area - 2 if area > 666 else area - 1) * 99 + group - 1) * 9999 + serial - 1, pii.SSN_HALVES, key, "ssn")
        rank, n_group = divmod(n // 9999, 99)
        return f"{rank + 2 if rank >= 665 else rank + 1:03}-{n_group + 1:02}-{n % 9999 + 1:04}"

    def iban(text):
        digits = iter(brute_digits(re.sub(r"\D", "", text[4:]), key, "iban"))
        body = "".join(next(digits) if c.isdigit() else c for c in text[4:])
        number = int("".join(str(int(c, 36)) for c in body + text[:2] + "00"))
        return f"{text[:2]}{98 - number % 97:02}{body}"

    cases = [
        ("4111111111111111", brute_luhn(brute_digits("411111111111111", key, "card"))), ("378282246310005", brute_luhn(brute_digits("37828224631000", key, "card"))),
        ("2024-02-29", day("2024-02-29", "%Y-%m-%d")), ("31.12.1999", day("1999-12-31", "%d.%m.%Y")), ("12/31/1999", day("1999-12-31", "%m/%d/%Y")),
        ("97.51.17.173", ip("97.51.17.173")), ("123-45-6789", ssn("123-45-6789")), ("899-99-9999", ssn("899-99-9999")),
        ("GB82WEST12345698765432", iban("GB82WEST12345698765432")), ("DE89370400440532013000", iban("DE89370400440532013000")),
        ("212-555-0100", None), ("+1 212 555 0100", None), ("ana.68@mail7.example.com", brute_text("ana.68", key, "email") + "@mail7.example.com"),
        (f"token = {token}", f"token = {brute_text(token, key, 'secret')}"), (f"password: {password}", f"password: {brute_text(password, key, 'secret')}"),
        (f"api_key={long_hex}", f"api_key={brute_hex(long_hex, key, 'secret')}"),
    ]
    phone = brute_digits("2125550100", key, "phone")
    cases[10:12] = [("212-555-0100", f"{phone[:3]}-{phone[3:6]}-{phone[6:]}"), ("+1 212 555 0100", f"+1 {phone[:3]} {phone[3:6]} {phone[6:]}")]
    rows = [(1000 + i, f"So {old} ends") for i, (old, _) in enumerate(cases)] + [(100, filler + " ".join(old for old, _ in cases) + " " + filler)] + ODD
    found = pii.op4_pii(spark, sf_dir(rows)).collect()
    expected = [(1000 + i, f"So {new} ends", 1) for i, (_, new) in enumerate(cases)] + [(100, filler + " ".join(new for _, new in cases) + " " + filler, len(cases))] + [(i, t, 0) for i, t in ODD]
    assert sorted(((r.doc_id, r.text, r.n_private) for r in found), key=str) == sorted(expected, key=str)


# Exact dedup


def test_an_index_that_is_opened_again(spark, docs, tmp_path):
    place = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, place, buckets=16)
    assert index.add(docs([(i, f"text {i}") for i in range(500)])).count() == 500
    index.close()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        again = exact_dedup.DigestIndex(spark, place)
        assert again.buckets == 16
        assert sorted(r.doc_id for r in again.add(docs([(1000 + i, f"text {i}") for i in range(450, 550)])).collect()) == list(range(1500, 1550))
        assert again.table().count() == 550
        again.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="16 buckets"):
        exact_dedup.DigestIndex(spark, place, buckets=8)


def test_a_batch_whose_result_was_lost(spark, docs, monkeypatch):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None)]
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(docs([(0, "b")]), batch_id="first")

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # digests are in the index, and then the job dies
        m.setattr(common, "finished", lost)
        with pytest.raises(RuntimeError, match="lost"):
            index.add(docs(rows), batch_id="second")
    assert index.table().count() == 3
    for _ in range(2):
        assert sorted(r.doc_id for r in index.add(docs(rows), batch_id="second").collect()) == [2, 4]
        assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.verdicts(docs(rows), index, batch_id="second").collect()) == [(1, 2, False), (2, 2, True), (3, 0, False), (4, 4, True)]
    assert index.table().count() == 3 and index.add(docs(rows), batch_id="third").count() == 0
    index.drop()


def test_compaction_of_an_index(spark, docs, tmp_path):
    place = f"{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, f"file://{place}", buckets=4)
    for n in range(3):
        index.add(docs([(1000 * n + i, f"text {n} {i}") for i in range(100)]))
    assert len(glob.glob(f"{place}/digests-*/*.parquet")) > 4
    index.compact()
    assert len(glob.glob(f"{place}/digests-*/*.parquet")) == 4 and index.table().count() == 300
    with index._in_order():
        plan = index.unseen(spark.createDataFrame([(bytearray(b"d"),)], "digest binary"))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("SortMergeJoin") :]
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "Bucketed: true" in scan  # of the batch only
    assert index.add(docs([(1, "text 1 7"), (2, "new")])).count() == 1
    again = exact_dedup.DigestIndex(spark, f"file://{place}")
    assert again.table().count() == 301 and again.number == 1
    again.drop()
    assert not glob.glob(f"{place}/*")


# Search


def test_phases_of_the_search(spark, monkeypatch):
    """The second phase sends a part of the pairs, and the third one is needed."""
    monkeypatch.setattr(topk_search, "BLOCK", 100)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    table = spark.createDataFrame([(i, [math.floor(64 * x) for x in v]) for i, v in rows], "vec_id bigint, v array<bigint>")
    made, kept = {}, common.written

    def watched(df, name):
        made[name] = kept(df, name)
        if name in ("second", "third"):
            made[name, "n"] = sum(len(topk_search._loose(r["s"])) for r in made[name].collect())
        return made[name]

    monkeypatch.setattr(common, "written", watched)
    find = lambda: sorted(map(tuple, topk_search.search(table.where("vec_id % 20 = 0"), table, k=5).collect()))
    assert find() == brute_top(rows, 5)
    pairs = 30 * 599
    assert 0 < made["second", "n"] < pairs / 2 and 0 < made["third", "n"] < made["second", "n"]
    monkeypatch.setattr(topk_search, "_third_phase", lambda batches, *, lists: (topk_search._entries(r, np.zeros(0), np.zeros(0), np.zeros(0)) for b in batches for r in b.to_pylist()))
    assert find() != brute_top(rows, 5)


@pytest.mark.parametrize("lists", [1, 2, 3, 5])
def test_any_number_of_lists(spark, lists):
    rows = vectors(lists, 120, 7)
    table = spark.createDataFrame([(i, [math.floor(64 * x) for x in v]) for i, v in rows], "vec_id bigint, v array<bigint>")
    assert sorted(map(tuple, topk_search.search(table.where("vec_id % 20 = 0"), table, lists=lists).collect())) == brute_top(rows, 20)


# Substring dedup


@pytest.mark.parametrize("width", [1, 2, 5, 11])
def test_two_least(width):
    values = np.random.default_rng(width).integers(0, 9, 200).astype(np.uint64)
    found = substring_dedup._second_of(values, width)
    for i, x in enumerate(found.tolist()):
        two = sorted(set(values[i : i + width].tolist()))
        assert x == (two[1] if len(two) > 1 else 2**64 - 1)


def common_runs(seed, n):
    """Texts full of the same words and passages."""
    rnd = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    parts = ["of the people", "the same old words again and again", passage, "a a a a a a a a a a a a a a a a", "in the end of the day"]
    return [(i, " ".join(rnd.choice([*parts, f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(25)))) for i in range(n)]


@pytest.mark.parametrize("rows", [common_runs(1, 150), varied(21, 120), ODD + common_runs(2, 60)])
def test_hot_minimisers(spark, sf_dir, monkeypatch, rows):
    """Nearly every minimiser is hot: windows go to buckets by two hashes, and through salted groups."""
    monkeypatch.setattr(substring_dedup, "HOT_BUCKETS", 0)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.003)
    made, kept, hot = {}, common.written, []

    def watched(df, name):
        made[name] = kept(df, name)
        if name == "repeats":
            made["salted"] = made[name].where("packed IS NOT NULL").count()
        return made[name]

    monkeypatch.setattr(common, "written", watched)
    found_hot = substring_dedup.hot_minimisers
    monkeypatch.setattr(substring_dedup, "hot_minimisers", lambda *a: hot.append(found_hot(*a)) or hot[-1])
    # More tasks than rows of a task, so that equal windows meet in the second step only.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = substring_dedup.op2_substring_dedup(spark, sf_dir(rows)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, found), key=str) == sorted(brute_windows(rows, 13), key=str)
    assert len(hot[0]) > 3 and made["salted"] > 3


def test_frequent_minimisers():
    import pyarrow as pa

    rows = common_runs(3, 400)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    count = lambda most: {r["minimiser"]: r["windows"] for b in substring_dedup._frequent(iter([batch]), k=13, most=most) for r in b.to_pylist()}
    whole = count(10**6)
    assert whole[None] == sum(max(0, len(t.split()) - 12) for _, t in rows) == sum(n for m, n in whole.items() if m is not None)
    few = count(20)
    assert len(few) <= 21 and all(whole[m] - whole[None] / 20 <= few.get(m, 0) <= whole[m] for m in whole if m is not None)


# Near dedup


@pytest.mark.parametrize("share", [1, 4])
def test_hot_keys_are_dealt(spark, sf_dir, monkeypatch, share):
    """Groups of copies that hold a third of the rows each, all keys of some size being hot."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rnd = random.Random(11)
    base = [str(rnd.randrange(1000)) for _ in range(60)]
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(60)]
    rows = [(i, near[i % 60]) for i in range(120)] + [(200 + i, "one and the same text of all these") for i in range(100)] + [(400 + i, t) for i, t in varied(12, 100, 3)]
    found = minhash.op5_minhash(spark, sf_dir(rows)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))


def test_blocks_are_bounded_by_bytes(spark, sf_dir, monkeypatch):
    """Long documents that share buckets are not put into one block."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 16_000)
    seen, rnd = [], random.Random(13)
    base = [str(rnd.randrange(10**6)) for _ in range(1000)]
    rows = [(i, " ".join([*base[: 10 * i], f"new{i}", *base[10 * i + 1 :]])) for i in range(60)] + [(100, "short one"), (101, "Short one")]
    path = sf_dir(rows)

    def watched(members, sets, percent, verified=minhash._verified):
        frame = type(members)

        def grouped(df, *cols, group_by=frame.groupBy):
            if cols == ("task",):
                seen.extend(r[0] for r in group_by(df, "task").agg(F.sum(F.octet_length("set"))).select("sum(octet_length(set))").collect())
            return group_by(df, *cols)

        with monkeypatch.context() as m:
            m.setattr(frame, "groupBy", grouped)
            return verified(members, sets, percent)

    monkeypatch.setattr(minhash, "_verified", watched)
    found = minhash.op5_minhash(spark, path).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))
    assert len(seen) > 8 and max(seen) < 8 * 16_000


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rnd = random.Random(seed)
    nodes = rnd.sample(range(10**6), 300)
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(260)] + list(zip(nodes[:80], nodes[1:80], strict=False))
    key = lambda i: bytearray(i.to_bytes(4, "big"))
    group = {n: n for e in edges for n in e}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    found = minhash.components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")).collect()
    expected = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.comp, "big") for r in found} == expected and len(found) == len(expected)


# SQL


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_registered_sql(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = duck.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, sf).select(*expected.columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected.fetchall())


# Pipeline


@pytest.mark.parametrize("work", [partial(minhash._sketched, shingle=5, rows=4, count=40), partial(minhash._sets, shingle=5), partial(toxicity._scored, model=toxicity.train([], []), column="text", name="score")])
def test_workers_give_back_their_last_batch(monkeypatch, work):
    """When a task gives its memory back, the 4 MB it had last are gone."""
    left, before = [], pa.total_allocated_bytes()
    monkeypatch.setattr(common, "release_memory", lambda: left.append(pa.total_allocated_bytes() - before))

    def batches():
        yield pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text_hash": [1, 2, 3, 4], "text": ["word " * 200_000] * 4})

    assert sum(len(b) for b in work(batches())) == 4
    assert len(left) == 1 and left[0] < 1 << 20


def test_pipeline_packs_what_is_left(spark, sf_dir):
    """The last stage's pieces are the library's ids of the texts before it, in sequences without gaps."""
    rows, labels = toxic_corpus(150)
    path = sf_dir(rows + [(1000 + i, t) for i, t in varied(9, 60, 2)] + [(2000, "long " * 5000), (2001, None), (2002, "Mail ana.68@mail7.example.com")], labels)
    docs = common.table(spark, path, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, path), "test-stage")
    encode, expected = ids_of(bpe.word_vocabulary()), []
    for r in docs.collect():
        ids = encode(r.text)
        expected += [(r.doc_id, n, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    found = corpus_pipeline.run(spark, path)
    rows = found.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    places = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    used, bound = packing.certificate(found)
    assert max(places.values()) <= 2048 and bound <= used == len(places) <= 1.05 * bound + 1

"""Results are functions of the tables: however rows are dealt, whatever other columns are called, whichever rows repeat."""

import random

import brute
import pytest

from tidemark.llm import bpe, chunks, exact_dedup, near_dedup, packing, pii, quality_rules, token_counts, token_files, warc

BYTES = chunks.vocabulary("byte_bpe_50k.json")


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def graded():
    """Documents that the base rule passes, bad ones with many symbols, and labels of most of them."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(160):
        bad = i % 3 == 0
        words = [("#" * rng.randint(2, 5) if bad and rng.random() < 0.5 else "") + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
        docs.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 0 if bad else 1))
    # A labelled id that repeats, with another text and with the same.
    return [*docs, (1, docs[0][1]), (1, docs[1][1])], [*labels, (2, None), (None, 0), (1, 1)]


@pytest.mark.parametrize("query", ["judged", "kept"])
def test_quality_verdicts_do_not_depend_on_layout(spark, docs, graded, query):
    rows = spark.createDataFrame(graded[0], "doc_id long, text string")
    labels = spark.createDataFrame(graded[1], "doc_id long, quality int")
    found = [_rows(getattr(quality_rules, query)(rows.repartition(n), labels.repartition(n))) for n in (1, 5, 13)]
    assert found[0] == found[1] == found[2]
    if query == "judged":
        kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(rows.where("doc_id <> 1"), labels).collect()}
        wrong = sum(kept[i] == (i % 3 == 0) for i in kept)
        assert len(set(kept.values())) == 2 and wrong <= 8


def test_taught_rows_are_bounded_by_their_labels(spark, docs, graded):
    many = spark.range(500).selectExpr("1L AS doc_id", "concat('w ', id) AS text").union(spark.createDataFrame(graded[0], "doc_id long, text string"))
    labels = spark.createDataFrame(graded[1], "doc_id long, quality int")
    from pyspark.sql import functions as F

    labelled = quality_rules.with_statistics(many, "text", ["doc_id"]).join(F.broadcast(quality_rules.labelled_sample(labels)), F.col("_in_0") == F.col("_td_label_id"))
    taught = quality_rules._taught(labelled)
    assert len(taught) == len(set(taught["_in_0"])) and list(taught["_in_0"]) == sorted(taught["_in_0"])


def test_packing_does_not_depend_on_layout(spark, corpus, docs):
    rows = docs.select("doc_id", "text").union(docs.where("doc_id % 9 = 0").select("doc_id", "text")).union(spark.createDataFrame([(None, "no id"), (None, "no id"), (None, None), (2**60 + 1, "far")], "doc_id long, text string"))
    found = [_rows(packing.pack(rows.repartition(n), BYTES, end_id=1, room=64)) for n in (1, 5, 13)]
    assert found[0] == found[1] == found[2]
    assert any(str(2**60 + 1) in r for r in found[0]) and sum("(None" in r for r in found[0]) == 3


def test_a_hot_repeated_document_spreads_over_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 50)
    rows = spark.range(1_000).selectExpr("7L AS doc_id", "'the same words' AS text")
    made = packing.pack(rows, BYTES, end_id=1, room=64).selectExpr("sequence_id >> 40 AS g", "sequence_id", "offset", "length").collect()
    sizes = {g: sum(r["g"] == g for r in made) for g in {r["g"] for r in made}}
    assert len(made) == 1_000 and len(sizes) == 20 and max(sizes.values()) < 120
    assert len({(r["sequence_id"], r["offset"]) for r in made}) == 1_000


def test_odd_column_names_pass_through(spark, corpus, docs):
    odd = docs.selectExpr("doc_id", "text", "start AS `a.b`", "kept AS `_td_null`", "keep_id AS `_in_0`", "start AS `we``ird`", "kept AS `n_mail`", "keep_id AS `_td_gone`")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for made in (exact_dedup.deduplicated(odd), quality_rules.kept(odd, labels), pii.replace(odd, "k", findings=False), near_dedup.representatives(odd)):
        assert made.columns == odd.columns and made.count() > 0
    assert pii.replace(odd, "k").columns[len(odd.columns) :][:2] == ["spans", "n_mail_"]


def test_texts_with_one_beginning_are_sorted_by_all_their_bytes(spark, docs):
    """A third of all rows share more than the splitters' prefix; groups of copies among them lie in any partition."""
    rng = random.Random(8)
    head = "x" * (exact_dedup.PREFIX + 40)
    rows = [(i, head + str(rng.randrange(60)) + " " * rng.randrange(3)) for i in range(600)] + [(600 + i, f"{i} other") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.exact(rows)
    for n in (1, 7):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups(df.repartition(n)).collect()}
        assert got == want
    assert {r["doc_id"] for r in exact_dedup.deduplicated(df).collect()} == {i for i, (_, _, kept) in want.items() if kept}


def test_lookup_over_all_shards(spark, corpus, docs, tmp_path):
    words = chunks.vocabulary("word_bpe_49k.json")
    rows = docs.select("doc_id", "text").union(spark.range(300).selectExpr("5L", "concat('row ', id)")).union(spark.range(40).selectExpr("CAST(NULL AS BIGINT)", "'nobody'"))
    shards = token_files.write(rows, str(tmp_path / "tokens"), words, end_id=2)
    assert shards.count() > 2
    entries = token_files.read(shards).collect()
    assert len(entries) == rows.count() and sum(r["doc_id"] is None for r in entries) == 40
    # A repeated id does not make one shard of all its rows.
    assert shards.where("first_key <= 5 AND last_key >= 5").count() > 1
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(words)
    texts = {i: t or "" for i, t in corpus if i != 5}
    for key in (0, 7, 20, 60):
        assert token_files.get(shards, key).tolist() == [*plain.encode(texts[key], add_special_tokens=False).ids, 2]
    assert token_files.get(shards, 10**9) is None
    asked = spark.createDataFrame([(k,) for k in (0, 7, 7, 99_999, None, 30)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(shards, asked).collect()}
    assert set(found) == {0, 7, 30} and all(found[k] == [*plain.encode(texts[k], add_special_tokens=False).ids, 2] for k in found)


@pytest.mark.parametrize(("width", "block", "span"), [(2, 6, 2), (4, 8, 1), (4, 4096, 3), (2, 1, 1000)])
def test_flat_files_of_any_width(spark, docs, tmp_path, monkeypatch, width, block, span):
    import numpy as np

    monkeypatch.setattr(token_counts, "SPAN", span)
    rng = np.random.default_rng(width * block)
    end, ids = 70_000 if width == 4 else 9, []
    for size in (0, 3, 1, 40, 1, 1, 9, 0, 17, 2):
        ids += [*rng.integers(10, 60_000, size).tolist(), end]
    ids += [11, 12, 13]
    cuts, files = [0, 5, 5, 30, 31, len(ids)], []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        path = tmp_path / f"{k}.bin"
        path.write_bytes(np.array(ids[a:b], f"<u{width}").tobytes())
        files.append((str(path), width * (b - a)))
    want, size = [], 0
    for i in ids:
        size += 1
        if i == end:
            want.append((len(want), size, True))
            size = 0
    want.append((len(want), size, False))
    assert sorted(map(tuple, token_counts.count_tokens(spark, files, end, block, width).collect())) == want


def test_counts_of_null_and_repeated_ids(spark, docs):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "")], "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.documents_counted(rows, BYTES, 50256).collect())
    assert got == [("1", 3), ("1", 3), ("2", 1), ("None", 1), ("None", 2)]
    same = sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.round_trip(rows, BYTES).collect())
    assert same == [("1", 2), ("1", 2), ("2", 0), ("None", 0), ("None", 1)]


def test_repeated_pages(spark, docs, tmp_path):
    long = "p" * 1_200
    rows = spark.createDataFrame([(1, "u", long), (1, "u", long), (3, "v", long), (None, "w", long), (4, None, "short"), (4, None, "short")], "page_id long, url string, html string").repartition(2)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read(warc.archive(rows, str(tmp_path / "w"))).collect())
    assert got == [("1", "revisit", "3"), ("1", "revisit", "3"), ("3", "response", "None"), ("4", "response", "None"), ("4", "response", "None"), ("None", "revisit", "3")]


def _variants(n, rng):
    """A template, and variants that change every shingle near one or two of its 120 words."""
    base = [f"t{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 2)):
            words[k] = f"v{i}_{k}"
        rows.append((i, " ".join(words)))
    return rows


def test_a_template_with_many_variants_is_no_square(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    dealt = []
    plain = near_dedup._cells

    def counted(rows, opened):
        made = plain(rows, opened)
        dealt.append(made.count())
        return made

    monkeypatch.setattr(near_dedup, "_cells", counted)
    rows = _variants(400, random.Random(2))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert set(got.values()) == {0}
    # All pairs of blocks would be 400 * 25 rows.
    assert sum(dealt) < 2 * len(rows)


def test_members_that_no_centre_reaches_are_compared_with_all(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "VERIFIED", 1)
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"s{k}" for k in range(70)] + [f"g{i // 4}_{k}" for k in range(30)]
        if i % 4:
            words[70 + rng.randrange(30)] = f"x{i}"
        rows.append((i, " ".join(words)))
    want = brute.near(rows, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == want


def test_near_links_of_null_and_repeated_ids(spark, docs):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near_two = two + " more"
    rows = [(1, one), (1, one), (2, two), (2, one + " end"), (3, near_two), (None, one), (4, None), (5, one)]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("2", "1", False), ("3", "1", False), ("4", "4", True), ("5", "1", False), ("None", "None", True)]

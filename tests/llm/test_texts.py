import random
import re

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.llm import language_id, pii, quality_rules, shared, warc

KEY = b"k" * 32


def test_statistics():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\t#é|") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, "\n", "a\na\n a\na", "x y z x y z"]
    made = quality_rules.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert {k: made[k][i] for k in brute.statistics(t)} == brute.statistics(t)


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({f"_td_{s}": rng.integers(50, 500, n) for s in quality_rules.STATISTICS})
    rows["_td_word_chars"] = rows["_td_n_words"] * 5
    rows["_td_n_symbols"] = rng.integers(0, 50, n)
    rows["_td_label"] = np.where((rows["_td_n_symbols"] > 0.05 * rows["_td_word_chars"]), 0, 1)
    return rows


def test_decision_list_is_right_on_held_out_rows():
    rules = quality_rules.learn(labelled(1500, 1))
    there = labelled(1500, 2)
    assert rules.rules and np.mean(rules.rejects(quality_rules.ratios(there)) == (there["_td_label"] == 0)) > 0.95
    assert quality_rules.learn(there.iloc[:0]).rules == () and quality_rules.learn(there.assign(_td_label=1)).rules == ()


def test_verdicts(spark, corpus, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in corpus] + [(None, 1), (3, None), (10**9, 0)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality_rules.judged(docs, labels).collect()}
    for i, t in corpus:
        want = brute.statistics(t)
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert {k: rows[i][k] for k in want} == want and rows[i]["base_failed"] == failed and not (failed and rows[i]["kept"])
    assert {r["doc_id"] for r in quality_rules.kept(docs, labels).collect()} == {i for i, r in rows.items() if r["kept"]}
    assert quality_rules.kept(docs, labels.where("quality > 5")).columns == docs.columns
    assert quality_rules.judged(nothing, labels).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60):
        e, m, f = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.random(n) < 0.2
        f[0] = True
        a, b, s, t = np.zeros((n, 3)), np.ones((n, 3)), np.exp(e), np.exp(m)
        for i in range(n):
            a[i] = s[i] * (1 if f[i] else a[i - 1] @ t)
        for i in range(n - 2, -1, -1):
            b[i] = 1 if f[i + 1] else t @ (s[i + 1] * b[i + 1])
        assert np.allclose(language_id.marginals(e, m, f)[0], a * b / (a * b).sum(1, keepdims=True))


def test_language_identification(spark, docs, nothing):
    rng = random.Random(4)
    words = {"aa": ["bal", "gor", "mun", "tes"], "bb": ["que", "ción", "los", "por"], "cc": ["der", "und", "ß", "zwei"]}
    rows = [(i, " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(sorted(words)) for _ in range(300))]
    mixed = [(1000, None, "aa"), (1001, "12 !!", None), (1002, "", None), (1003, "undder zweiund derß balgor", None)]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    unseen = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert unseen and np.mean([got[i]["lang_pred"] == lang for i, lang in unseen]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(df.where("doc_id < 0")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("lang <> ''")).collect()} == set()


def test_permutations():
    for n in (2, 3, 10, 97, 1000):
        images = [pii.permuted(i, n, KEY, b"t") for i in range(n)]
        assert sorted(images) == list(range(n)) and sum(i == x for i, x in enumerate(images)) <= n % 2


@pytest.mark.parametrize(
    ("value", "kind", "shape"),
    [
        ("4981021525375367", "card", r"\d{16}"), ("4981-0215-2537-5367", "card", r"(\d{4}-){3}\d{4}"), ("GB82 WEST 1234 5698 7654 32", "account", r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d"), ("123-45-6789", "social", r"\d{3}-\d\d-\d{4}"),
        ("2024-02-29", "day", r"\d{4}-\d\d-\d\d"), ("31/12/1999", "day", r"\d\d/\d\d/\d{4}"), ("213.174.22.103", "address", r"(\d{1,3}\.){3}\d{1,3}"), ("+1 (437) 555-0689", "phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("a.person@mail1.example.com", "mail", r"[a-z]\.[a-z]{6}@[a-z]{4}\d\.[a-z]{7}\.com"),
    ],
)
def test_pseudonyms_keep_their_format(value, kind, shape):
    out, found = pii.pseudonymised(f"so {value}, again {value}.", KEY)
    a, b = re.fullmatch(r"so (.*), again (.*)\.", out).groups()
    assert a == b != value and re.fullmatch(shape, a) and [k for _, _, k in found] == [kind, kind]
    assert pii.pseudonymised(out, KEY)[1] and pii.pseudonymised(f"so {value}", b"o" * 32)[0] != f"so {a}"


@pytest.mark.parametrize("text", ["4981021525375368", "2023-02-30", "999.1.1.1", "000-12-3456", "version 1.2.3.4.5", "pages 10-20 of 1999", "GB82 WEST 1234 5698 7654 33", "3.14159 and 1,000,000"])
def test_invalid_values_are_left_alone(text):
    assert pii.pseudonymised(text, KEY) == (text, [])


def test_replacing(spark, docs):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!', 7)], "spans long, text string, doc_id int")
    got = {r["doc_id"]: r["text"] for r in pii.replace(rows, "key", findings=False).collect()}
    assert got[5] is None and got[6] == "" and re.fullmatch(r'token = "[0-9A-F]{40}"!', got[7]) and "9233A8EC" not in got[7]
    assert pii.replace(rows.where("doc_id < 0"), "key").count() == 0


def arc(version, blocks, date="20010203040506"):
    return warc.arc_description(version, "x.arc", date) + b"".join(warc.arc_record(version, u, "1.2.3.4", date, "text/html", b) for u, b in blocks)


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_becomes_warc(version):
    blocks = [("http://a/ b", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n\n\nhi\n"), ("dns:a", b"20010203 a"), ("http://c", b"")]
    made = [warc.parse_warc(warc.to_warc(r)) for r in warc.parse_arc(arc(version, blocks))]
    assert [m.headers["warc-type"] for m in made] == ["warcinfo", "response", "response", "resource"]
    assert [m.block for m in made[1:]] == [b for _, b in blocks] and made[1].headers["warc-date"] == "2001-02-03T04:05:06Z"
    assert made[1].headers["warc-payload-digest"] == f"sha1:{warc.sha1_hex(b'%s' % bytes([10, 10]) + b'hi' + bytes([10]))}" and len({m.headers["warc-record-id"] for m in made}) == 4


@pytest.mark.parametrize("data", [b"http://x 1.2.3.4 20010101000000 a/b 3\nabc\n", arc("1", [("u", b"abc")])[:-3], arc("2", [("u", b"abc")]).replace(b" 3\n", b" x\n")])
def test_damaged_archives_are_told(data):
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(data))


def test_pages_through_archives(spark, docs):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "u", big), (5, None, big), (3, "a b", big), (2, "v", small), (4, "w", small), (6, "", None), (7, "z", ""), (None, "n", big), (8, "q", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(warc.archive(df, shared.fresh_folder(spark, "w"))).collect()}
    digest = lambda s: warc.sha1_hex((s or "").encode())
    want = {i: (len((h or "").encode()), digest(h), "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else None) for i, _, h in rows}
    assert got == want
    assert warc.read(warc.archive(df.where("page_id < 0"), shared.fresh_folder(spark, "w"))).count() == 0

"""Operators that SQL cannot express, beside versions that do one thing after the other."""

import datetime
import random
import re
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import chunks, language_id, pii, quality_rules
from tidemark.llm.queries import PSEUDONYM_KEY, QUERIES

KEY = b"k" * 32


# Personal data.


def _luhn(body):
    for c in "0123456789":
        if pii.luhn_sum(body + c) % 10 == 0:
            return body + c


def _account(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    return next(f"DE{c:02d}{body}" for c in range(2, 99) if pii._mod97(f"{body}DE{c:02d}") == 1)


def _value(kind, rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return {
        "mail": lambda: f"{rng.choice(['ana', 'bo.li', 'c_9'])}{digits(2)}@host{digits(1)}.example.org",
        "secret": lambda: "".join(rng.choice("abcXYZ019") for _ in range(14)),
        "key": lambda: "AKIA" + "".join(rng.choice("ABCDEF0123456789") for _ in range(16)),
        "account": lambda: _account(rng),
        "card": lambda: _luhn("4" + digits(14)),
        "social": lambda: f"{rng.randint(1, 600):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "day": lambda: (datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(30_000))).isoformat(),
        "address": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"+49 {digits(3)} {digits(4)} {digits(2)}",
    }[kind]()


_VALID = {
    "mail": lambda a, b: re.fullmatch(r"[a-z0-9._]+@[a-z0-9.]+\.org", b) and [len(x) for x in re.split(r"[@.]", a)] == [len(x) for x in re.split(r"[@.]", b)],
    "secret": lambda a, b: len(a) == len(b),
    "key": lambda a, b: len(a) == len(b) and b == b.upper(),
    "account": lambda a, b: a[:2] == b[:2] and len(a) == len(b) and pii._mod97(b[4:] + b[:4]) == 1,
    "card": lambda a, b: len(a) == len(b) and pii.luhn_sum(b) % 10 == 0,
    "social": lambda a, b: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", b),
    "day": lambda a, b: datetime.date.fromisoformat(b),
    "address": lambda a, b: all(0 <= int(x) <= 255 for x in b.split(".")),
    "phone": lambda a, b: re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) and b.startswith("+49 "),
}


@pytest.fixture(scope="module")
def planted():
    """Texts put together from plain words and values, and where each value stands."""
    rng = random.Random(12)
    values = [(k, _value(k, rng)) for k in pii.NAMES for _ in range(12)]
    rows = []
    for i in range(220):
        text, spans = "", []
        for _ in range(rng.randint(0, 6)):
            text += " ".join(rng.choice(["river", "meant", "Über", "well", "x9y"]) for _ in range(rng.randint(1, 9))) + rng.choice([" ", "\n", ": "])
            kind, value = rng.choice(values)
            text += "password: " if kind == "secret" else ""
            spans.append((len(text), len(text) + len(value), kind, value))
            text += value + rng.choice([", ", "; then ", "\n"])
        rows.append((i, text, spans))
    return rows


def test_planted_values_are_replaced_and_nothing_else(spark, docs, planted):
    table = spark.createDataFrame([(i, t) for i, t, _ in planted] + [(900, None), (901, ""), (902, planted[3][1]), (902, planted[3][1])], "doc_id long, text string")
    found = {}
    for r in pii.replace(table.repartition(3), key="a key").collect():
        found.setdefault(r["doc_id"], []).append(r)
    images = {}
    for i, text, spans in planted:
        made = found[i][0]
        assert [(s["start"], s["end"], s["kind"]) for s in made["spans"]] == [s[:3] for s in spans]
        assert len(made["text"]) == len(text) or any(k == "address" for *_, k, _ in spans)
        at = last = 0
        for start, end, kind, value in spans:
            between = text[last:start]
            assert made["text"][at : at + len(between)] == between
            at += len(between)
            size = end - start if kind != "address" else len(re.match(r"[\d.]*\d", made["text"][at:])[0])
            image = made["text"][at : at + size]
            assert _VALID[kind](value, image), (kind, value, image)
            assert images.setdefault((kind, value), image) == image
            at, last = at + size, end
        assert made["text"][at:] == text[last:]
        assert all(made[f"n_{k}"] == sum(x[2] == k for x in spans) for k in pii.NAMES)
    # Different values of a kind stay different.
    assert len({(k, v) for (k, _), v in images.items()}) == len(images)
    assert found[900][0]["text"] is None and found[901][0]["text"] == "" and found[902][0]["text"] == found[902][1]["text"] == found[3][0]["text"]


def test_networks_permute_every_number_of_a_domain():
    for size in (2, 3, 10, 97, 100, 1_000):
        images = [pii.permuted(x, size, KEY, b"t") for x in range(size)]
        assert sorted(images) == list(range(size))
        plain = [pii._walked(x, size, KEY, b"t") for x in range(size)]
        for x in range(size):
            pair = x ^ 1
            swapped = pair < size and (plain[x] == x or plain[pair] == pair)
            assert images[x] == (plain[pair] if swapped else plain[x])


def test_long_and_many_values_take_time_in_proportion(spark, docs):
    import time

    text = "password=" + "aB3" * 60_000 + " " + " ".join(f"a{i}@b{i}.example.org" for i in range(8_000))
    began = time.process_time()
    made, found = pii.pseudonymised(text, KEY)
    assert len(found) == 8_001 and len(made) == len(text) and time.process_time() - began < 20
    assert pii.pseudonymised("token: " + "0f" * 40_000, KEY)[1][0][1] == 80_007


# Languages.


def _babel(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_words_of_mixed_texts_get_their_own_language(spark, docs):
    rng = random.Random(5)
    sounds = {"aa": "abdeilmnou", "bb": "fghkpqrtuy", "cc": "cjosvwxzei"}
    taught = [(i, _babel(rng, sounds[k], 60), k) for i, k in enumerate(sorted(sounds) * 30)]
    rows = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(rows, ~language_id.held_out("doc_id"), "doc_id", "text", "lang"))
    mixed = [(1, _babel(rng, sounds["aa"], 20) + " " + _babel(rng, sounds["bb"], 30) + " " + _babel(rng, sounds["cc"], 10)), (2, None), (3, "1 2 3"), (4, _babel(rng, sounds["cc"], 3_000))]
    got = {r["doc_id"]: (r["words"], r["langs"]) for r in language_id.word_labels(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    want = ["aa"] * 20 + ["bb"] * 30 + ["cc"] * 10
    assert got[1][0] == mixed[0][1].split() and sum(a == b for a, b in zip(got[1][1], want, strict=True)) >= 54
    assert got[2] == ([], []) and got[3] == ([], [])
    assert sum(x == "cc" for x in got[4][1]) > 2_900
    # Labels of words, summed up by hand, are the prediction of the text.
    reader = language_id.Reader(model)
    sizes, told = reader._told([mixed[0][1]])
    assert reader.read([mixed[0][1]])[0] == [model.labels[int(told.sum(axis=0).argmax())]]


def test_the_sample_does_not_depend_on_layout(spark, docs):
    rows = spark.createDataFrame([(i % 40, f"wort{i % 7} und {i}", "de" if i % 2 else "en") for i in range(400)], "doc_id long, text string, lang string")
    teaches = ~language_id.held_out("doc_id")
    found = [language_id.sample(rows.repartition(n), teaches, "doc_id", "text", "lang") for n in (1, 4, 9)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


# Decision lists.


def test_a_list_is_what_its_conditions_say_one_after_the_other(spark, docs):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({f"_td_{s}": rng.integers(0, 50, 600) for s in quality_rules.STATISTICS})
    rows["_td_word_chars"] = rng.integers(30, 60, 600)
    rows["_td_label"] = ((rows["_td_n_symbols"] < 0.6 * rows["_td_word_chars"]) & (rows["_td_n_digits"] < 0.9 * rows["_td_word_chars"])).astype(int)
    made = quality_rules.learn(rows)
    assert made.rules

    def ratio(row, k):
        _, top, under = quality_rules.RATIOS[k]
        return float(row[f"_td_{top}"]) if under is None else row[f"_td_{top}"] / row[f"_td_{under}"] if row[f"_td_{under}"] > 0 else 0.0

    def keeps(row):
        for rule in made.rules:
            if all(ratio(row, c.ratio) >= c.threshold if c.above else ratio(row, c.ratio) <= c.threshold for c in rule.conditions):
                return False
        return True

    want = [keeps(row) for _, row in rows.iterrows()]
    df = spark.createDataFrame(rows.reset_index(names="i"))
    assert [r["k"] for r in df.orderBy("i").select(made.keeps().alias("k")).collect()] == want == [not x for x in made.rejects(quality_rules.ratios(rows))]
    assert np.mean([k == bool(v) for k, v in zip(want, rows["_td_label"], strict=True)]) > 0.9


def test_growing_takes_the_threshold_of_the_largest_gain():
    x = np.array([[float(i % 10), float(i // 10)] for i in range(100)])
    bad = x[:, 1] >= 7
    grown = quality_rules._grown(x, bad)
    assert [(c.ratio, c.above, c.threshold) for c in grown] == [(1, True, 7.0)]
    longer = [*grown, quality_rules.Condition(0, True, 5.0)]
    assert quality_rules._pruned(longer, x, bad) == grown


# The pipeline.


def test_the_pipeline_with_labels_and_personal_data(spark, docs, tmp_path):
    """Every stage decides: learned rules reject, copies and near copies go, values are replaced, pieces are packed."""
    rng = random.Random(9)
    texts, labels = {}, []
    for i in range(150):
        bad = i % 5 == 0
        words = [("$%" * rng.randint(2, 4) if bad and rng.random() < 0.6 else "") + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(70)]
        if i % 7 == 1:
            words[rng.randrange(70)] = "ana@example.org, 4111 1111 1111 1111"
        texts[i] = " ".join(words)
        labels.append((i, int(not bad)))
    for i in range(1, 30, 3):
        texts[200 + i] = texts[i].replace(" ", "\n")
        words = texts[i].split(" ")
        words[35] = "changed"
        texts[300 + i] = " ".join(words)
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    import pyarrow as pa

    ids = sorted(texts)
    stats = pd.DataFrame({f"_td_{s}": v for s, v in quality_rules.measure(pa.array([texts[i] for i in ids])).items()})
    stats["_td_label"] = [dict(labels).get(i, -1) for i in ids]
    rules = quality_rules.learn(stats[stats["_td_label"] >= 0])
    rejected = rules.rejects(quality_rules.ratios(stats))
    base = {i: brute.statistics(texts[i]) for i in ids}
    rows = {i: texts[i] for i, r in zip(ids, rejected, strict=True) if not r and base[i]["n_words"] >= 50 and 100 * base[i]["n_repeat_words"] <= 50 * base[i]["n_words"]}
    assert 0 < sum(i % 5 == 0 and i < 150 for i in ids) - sum(i % 5 == 0 and i < 150 for i in rows)
    after_rules = len(rows)
    rows = {i: rows[i] for i, (_, _, kept) in brute.exact(rows.items()).items() if kept}
    after_exact = len(rows)
    rows = {i: rows[i] for i, (_, c) in brute.near(rows.items(), 80).items() if i == c}
    assert after_rules > after_exact > len(rows)
    import hashlib

    key = hashlib.blake2b(PSEUDONYM_KEY.encode(), digest_size=32).digest()
    rows = {i: pii.pseudonymised(t, key)[0] for i, t in rows.items()}
    assert any(rows[i] != texts[i] for i in rows)

    pieces = corpus_pipeline.run(spark, folder).collect()
    plain = Tokenizer.from_file(chunks.vocabulary("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in pieces} == set(rows)
    by_sequence = {}
    for r in pieces:
        told = np.array([*plain.encode(rows[r["doc_id"]], add_special_tokens=False).ids, 1], np.uint32)
        part = told[r["start"] : r["start"] + r["length"]]
        assert len(told) == r["doc_tokens"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_every_query_is_registered_once_by_number():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))

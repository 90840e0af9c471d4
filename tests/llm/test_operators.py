"""Every corpus operator against a plain version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlib.llm import chat, decontaminate, fingerprints, licenses, mixing, neardup, passages, quality, shards, suffixes, tokens
from flowlib.llm.components import components
from tests.llm import plain

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "  \n", "!!! ???", "one", "Ünïcode wörds äre wörds too", "a" * 3000, "x\x00y <|endoftext|> z's don't", "  　 mixed\tspace  run "]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    """Documents of (doc_id, text), with columns that are named like results."""
    full = [(d, t, "en", s, None) for d, t, s in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    return docs.withColumns({"score": F.lit("mine"), "key": F.lit(1), "node": F.lit(2), "size": F.lit(3), "n_tokens": F.lit("x"), "labels": F.lit(None).cast("string"), "row": F.lit(0)})


@pytest.fixture(scope="module")
def rows():
    long = plain.prose(1, 6000)
    texts = [*ODD, long, long + " tail", plain.prose(2, 80), plain.prose(2, 80), plain.prose(3, 90)]
    near = plain.prose(4, 120).split()
    for i in range(12):
        copy = list(near)
        copy[(i * 9) % 120] = f"edit{i}"
        texts.append(" ".join(copy))
    source = ["b", "a", None, "", "c"]
    out = [(i * 3 + 1, t, source[i % 5]) for i, t in enumerate(texts)]
    return out + [out[11], out[11], (None, "no id at all", "a"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_quality_learns_and_skips_held_out(spark):
    draw = random.Random(5)
    good = [" ".join(draw.choice(["the", "cat", "sat", "on", "mats", "quietly"]) for _ in range(40)) for _ in range(150)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(7, None, 0), (None, 1, 0), (9, 5, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text", "score"), model).collect()}
    held = [r.doc_id for r in docs.where(quality.held_out(F.col("doc_id"))).collect()]
    assert 40 < len(held) < 110
    assert np.mean([(got[i] >= 0.7) == (i < 150) for i in held]) > 0.95
    # Labels of held-out rows aren't looked at.
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, turned).weights, model.weights)
    assert quality.accepted(docs, model).columns == docs.columns
    assert set(r.doc_id for r in quality.accepted(docs, model).collect()) == {i for i, s in got.items() if s >= 0.7}


def test_quality_learns_once_from_an_id_of_many_rows(spark, monkeypatch):
    rows = [(i, plain.prose(i, 30), "s") for i in range(40)]
    marks = [(i, i % 2, 0) for i in range(40)]
    schema = "doc_id bigint, quality int, toxic int"
    often = [(4, f"another text {n}", "s") for n in range(300)] + [rows[9]] * 50
    table = spark.createDataFrame(marks + [marks[1]] * 20 + [(3, 0, 0)], schema)
    learned, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda rows, share: learned.append((rows, share)) or train(rows, share))
    model = quality.fit(frame(spark, rows + often), table)
    assert np.array_equal(model.weights, quality.fit(frame(spark, often + rows).repartition(5), table).weights)
    smallest = min((t for d, t, _ in rows + often if d == 4), key=lambda t: hashlib.md5(t.encode()).digest())
    quality.fit(frame(spark, [(d, smallest if d == 4 else t, s) for d, t, s in rows]), spark.createDataFrame([(i, 0 if i == 3 else y, 0) for i, y, _ in marks], schema))
    kept = [i for i in range(40) if i not in {r.doc_id for r in frame(spark, rows).where(quality.held_out(F.col("doc_id"))).collect()}]
    assert {1, 4, 9, 3} <= set(kept) and [len(r) for r, _ in learned] == [len(kept)] * 3
    assert learned[0][1] == learned[2][1] and [r[2] for r in learned[0][0]] == [r[2] for r in learned[2][0]]
    assert all(np.array_equal(a[0], b[0]) for a, b in zip(learned[0][0], learned[2][0]))


def test_quality_without_labels_and_odd_texts(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, none)
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert scores == [0.5] * docs.count() and quality.score(empty, model).count() == 0
    _, of = quality.features(pa.array(ODD))
    assert (np.diff(of) > 0).all()


def test_contamination(spark, docs, rows, empty):
    lines = [t for _, t, _ in rows if t]
    items = [(1, " ".join(plain.words(lines[8])[50:75]).upper()), (2, "Wörds äre"), (2, "one"), (3, ""), (4, None), (None, plain.prose(3, 90)[:200]), (5, plain.prose(99, 30)), (6, "don't")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    got = sorted(map(str, (tuple(r) for r in decontaminate.contamination(docs, bench).drop("key").collect())))
    assert got == sorted(str((d, *plain.contamination(t, named))) for d, t, _ in rows)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not plain.contamination(t, named)[4] for _, t, _ in rows)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_mixing_meets_targets(spark, empty):
    rows = [(i, plain.prose(i, 5 + i % 40), f"s{min(i % 7, 4)}") for i in range(700)] + [(None, None, None), (3, "", "zero"), (3, "", "zero")]
    docs = frame(spark, rows)
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(rows) and got and sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(docs.repartition(7)).collect()))
    by = {}
    for r in got:
        assert r["size"] == 0 and r.taken == 0 or r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    assert all(abs(sum(r.taken for r in v) - v[0].target) <= 44 and v[0].target <= 3 * v[0].source_size + 1e-9 for v in by.values())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.repetitions for r in got)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_water_filling_rounds():
    """The level formula against rounds of clamping."""
    sizes, weights = [10, 1000, 5, 400, 80], [5, 2, 1, 5, 2]
    share, open_, left = {}, set(range(5)), float(sum(sizes))
    while open_:
        each = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if each[i] > 3 * sizes[i]}
        for i in over or open_:
            share[i] = 3.0 * sizes[i] if over else each[i]
        left, open_ = left - sum(share[i] for i in over), open_ - (over or open_)
    from tests.session import session

    spark = session()
    table = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert all(abs(got[f"s{i}"] - share[i]) < 1e-9 for i in range(5))


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, BPE).collect())
    want = sorted(((d is None, d or 0), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    assert got == want and tokens.count_tokens(empty, BPE).count() == 0


def test_units_cover_awkward_boundaries():
    draw = random.Random(8)
    encode = tokens.Encoder(BPE)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    pieces = ["a", "B", " ", "  ", "'s", "'", ".", ",", "!", "\n", "\t", "é", " ", "1", "<|endoftext|>", ")", "word", "日"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(1500)]
    assert encode.safe
    assert encode.counts(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello there, world", "", "été à la plage"]
    assert tokens.Encoder(path).counts(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]


def test_edited_fingerprints(docs, rows, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [255 - b for b in hashlib.md5((r[1] or "").encode()).digest()]))
    want = []
    for i, (d, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(bytes(r.fingerprint))
    assert len(by_id[rows[11][0]]) == 1 and by_id[rows[11][0]] == by_id[rows[12][0]]
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(docs.where(f"doc_id = {rows[13][0]}")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_estimate_similarity():
    words = plain.prose(20, 600, 10**6).split()
    for share in (0.2, 0.5, 0.9):
        errors = []
        for i in range(8):
            other = list(words)
            for j in random.Random(i).sample(range(600), int(600 * (1 - share) / 5)):
                other[j] = f"z{i}q{j}"
            a, b = " ".join(words), " ".join(other)
            s = fingerprints.signatures(pa.array([a, b]))
            errors.append(fingerprints.likeness(s[:1], s[1:])[0] - plain.jaccard(plain.shingles(a), plain.shingles(b)))
        assert abs(np.mean(errors)) < 0.05


def test_licenses(docs, rows, empty):
    base = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    scan = licenses.Scanner(base).scan
    n, found = scan("Released under the MIT License. And again, under the MIT licence; CC-BY-NC-4.0!".encode())
    assert n == 16 and [(d[0], d[2]) for d in found if d[4]] == [(1, "mit"), (11, "cc-by-nc")]
    assert {d[2] for d in found} == {"mit", "cc-by-nc", "cc-by-nc-4"}
    labels = lambda t: {d[2] for d in scan(t.encode())[1]}
    assert labels("GNU General Public License, version 3 or later") == {"gpl-3+"}
    assert labels("under the GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2"}
    assert labels("mit der Zeit") == set() and labels("") == set()
    assert scan(b"cc by nc cc by nc")[1][1][0] == 3
    got = licenses.scan_licenses(docs, base).collect()
    assert len(got) == len(rows) and all(r.n_base == 0 and r.first_word is None and 0 <= r.score <= 1 for r in got)
    assert sorted(r.n_words for r in got) == sorted(len(plain.words(t)) for _, t, _ in rows)
    assert licenses.scan_licenses(empty, base).count() == 0
    assert len(licenses.scanner(()).rules) >= 200


def test_every_license_rule_compiles_and_needs_its_keywords():
    for label, strength, words, text in licenses.parsed():
        assert 0 < strength <= 100 and all(w == w.lower() for w in words), label


def spelled(tree) -> list[str]:
    """A text for every alternative of a parsed pattern."""
    texts = [""]
    for kind, value in tree:
        match str(kind):
            case "LITERAL":
                more = [chr(value)]
            case "IN":
                more = [chr(v) for k, v in value if str(k) == "LITERAL"] or ["x"]
            case "ANY":
                more = ["x"]
            case "BRANCH":
                more = [t for branch in value[1] for t in spelled(branch)]
            case "SUBPATTERN":
                more = spelled(value[3])
            case "ASSERT":
                more = spelled(value[1])
            case "MAX_REPEAT" | "MIN_REPEAT":
                more = [t * n for t in spelled(value[2]) for n in {value[0], min(value[0] + 1, value[1])}]
            case _:
                raise ValueError(kind)
        texts = [a + b for a in texts for b in more]
    return texts


def test_every_alternative_of_a_license_rule_passes_its_keywords():
    from re import _parser

    scanner = licenses.Scanner(())
    for (label, _, words, text), rule in zip(licenses.parsed(), scanner.rules):
        for sentence in sorted({" ".join(t.split()) for t in spelled(_parser.parse(text))}):
            held = {licenses.SPELLINGS.get(w.encode(), w.encode()) for w in sentence.split()}
            assert set(map(str.encode, words)) <= held and rule[3].search(sentence.encode()), (label, sentence)


@pytest.mark.parametrize(
    "text, label",
    [
        ("Creative Commons Attribution-Non-Commercial", "cc-by-nc"), ("Creative Commons Attribution-NonCommercial", "cc-by-nc"),
        ("Creative Commons Attribution-No Derivatives", "cc-by-nd"), ("Creative Commons Attribution-NoDerivatives", "cc-by-nd"),
        ("Creative Commons Attribution-ShareAlike 3.0", "cc-by-sa-3"), ("Creative Commons Attribution Share Alike 4.0", "cc-by-sa-4"),
        ("Creative Commons Attribution Non-Commercial Share Alike", "cc-by-nc-sa"), ("Creative Commons Attribution Non-Commercial No Derivatives", "cc-by-nc-nd"),
        ("GPL 2 or newer", "gpl-2+"), ("GPL version 3 plus", "gpl-3+"), ("GPLv2 plus", "gpl-2+"), ("GPLv3plus", "gpl-3+"), ("GNU General Public License v2 or newer", "gpl-2+"),
        ("LGPL 2 plus", "lgpl-2+"), ("LGPL 2.1 or newer", "lgpl-2.1+"), ("LGPL 3 or any newer version", "lgpl-3+"), ("GNU Lesser General Public License 3 plus", "lgpl-3+"),
        ("AGPL 3 plus", "agpl-3+"), ("Affero General Public License 3 or newer", "agpl-3+"),
        ("PNG Reference Library License version 2", "libpng-2"), ("the beerware license", "beerware"), ("beer-ware license", "beerware"), ("CreativeML Open RAIL-M", "openrail-m"),
        ("you may not copy it", "proprietary"), ("do not reproduce", "proprietary"), ("for academic use only", "research-only"), ("for research purposes only", "research-only"),
        ("You should have received a copy of the GNU General Public License", "gpl"), ("fitness for a particular purpose and noninfringement", "mit"),
    ],
)
def test_license_alternatives_have_their_own_label(text, label):
    assert {d[2] for d in licenses.Scanner(()).scan(text.encode())[1]} == {label}


def test_dart_signatures_estimate_weighted_similarity():
    elements, weights = np.array([1, 2, 3, 4] * 2, np.uint64), np.array([1, 2, 5, 0.5, 3, 2, 1, 0.5])
    s = neardup.dart_signatures(elements, weights, np.array([0, 4, 8, 8]), 8000)
    assert abs((s[0] == s[1]).mean() - 4.5 / 10.5) < 0.02 and not s[2].any()
    twice = neardup.dart_signatures(np.array([9, 9, 7], np.uint64), np.ones(3), np.array([0, 3]), 64)
    assert np.array_equal(twice, neardup.dart_signatures(np.array([7, 9], np.uint64), np.ones(2), np.array([0, 2]), 64))


def test_a_line_repeated_throws_the_darts_of_its_distinct_shingles(monkeypatch):
    line = "the same short line again\n"
    thrown, throw = [], neardup._throw

    def counted(seed, *rest):
        thrown.append(len(seed))
        assert len(seed) <= 20, "an element a repeat"
        return throw(seed, *rest)

    monkeypatch.setattr(neardup, "_throw", counted)
    texts = pa.array([line * 100_000, line * 2, "one " * 100_000, "", None])
    signatures, worded = neardup.text_signatures(texts)
    # The line twice has all five shingles; a word a hundred thousand times has one.
    assert np.array_equal(signatures[0], signatures[1]) and thrown[0] == 11
    assert worded.tolist() == [True, True, True, False, False] and not signatures[3:].any()
    counts, _ = neardup.text_signatures(pa.array([line * 2, line * 3]), weighting="count")
    assert 0 < (counts[0] == counts[1]).mean() < 1


def test_near_duplicate_classes(docs, rows, empty):
    known = [(d, t) for d, t, _ in rows if d is not None]
    want = plain.classes(known)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect() if r.doc_id is not None}
    # Rows without an id join the class of their text.
    assert got == want
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert neardup.classes(empty).count() == 0


def test_large_buckets_and_groups_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup.in_blocks, "__defaults__", (4,))
    base = plain.prose(50, 150, 10**6).split()
    rows = []
    for i in range(40):
        copy = list(base)
        for j in random.Random(i).sample(range(150), i % 6):
            copy[j] = f"e{i}q{j}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = neardup.signature_nodes(docs)
    groups = components(neardup.candidate_links(nodes, block=4))
    links = components(neardup.true_links(docs, nodes, groups, block=4))
    whole = {r.node: r.root for r in components(neardup.true_links(docs, nodes, components(neardup.candidate_links(nodes)))).collect()}
    assert {r.node: r.root for r in links.collect()} == whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_shards_round_trip(spark, docs, rows, empty, tmp_path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    target = str(tmp_path / "shards")
    shards.write_shards(docs, target, RANKS, length=64, shard_bytes=16 << 10)
    got = shards.read_shards(spark, target, 64).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and len({r.shard for r in got}) > 3
    joined = {}
    for r in sorted(got, key=lambda r: r.sequence):
        joined.setdefault((r.doc_id, r.sequence), []).append(np.frombuffer(r.ids, np.uint16).tolist())
    want = {}
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "") + [shards.END]
        for k in range(0, len(ids), 64):
            want.setdefault((d, k // 64), []).append(ids[k:k + 64])
    assert {k: sorted(v) for k, v in joined.items()} == {k: sorted(v) for k, v in want.items()}
    some = shards.read_shards(spark, target, 64, 30, 50).collect()
    assert sorted(some) == sorted(r for r in got if 30 <= r.slot < 50)
    again = str(tmp_path / "again")
    shards.write_shards(docs, again, RANKS, length=64, shard_bytes=16 << 10)
    assert sorted(shards.read_shards(spark, again, 64).collect()) == sorted(got)
    none = str(tmp_path / "none")
    shards.write_shards(empty, none, RANKS, length=64)
    assert shards.read_shards(spark, none, 64).count() == 0


@pytest.mark.parametrize("second", [[(2, "bb"), (1, "aa")], [(1, "aa"), (2, "bc")], [(1, "aa"), (3, "bb")], [(1, "aab"), (2, "b")]])
def test_shards_fail_if_the_second_reading_differs(spark, tmp_path, second):
    read = str(tmp_path / "read")

    def reading(batches):
        import os

        for _ in batches:
            rows = second if os.path.exists(read) else [(1, "aa"), (2, "bb")]
            open(read, "w").close()
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])

    docs = spark.range(0, 1, 1, 1).mapInArrow(reading, "doc_id bigint, text string")
    with pytest.raises(Exception, match="in another order than in the first pass"):
        shards.write_shards(docs, str(tmp_path / "shards"), RANKS)


def test_checksum_does_not_depend_on_slices():
    ids, texts = pa.array([1, None, 3]), pa.array(["é x", None, "z" * 9])
    whole, cut = shards.Checksum(), shards.Checksum()
    whole.add(ids, texts)
    for i in range(3):
        cut.add(ids.slice(i, 1), texts.slice(i, 1))
    assert whole.value() == cut.value() != shards.Checksum().value()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 4096, 5000])
def test_permutation(n):
    assert sorted(shards.permuted(np.arange(n), n).tolist()) == list(range(n))


def test_suffix_arrays():
    draw = random.Random(3)
    for trial in range(150):
        text = bytes(draw.choice([0, 7, 255][: 1 + trial % 3]) for _ in range(draw.randint(1, 50))) * (1 + trial % 2)
        array = np.frombuffer(text, np.uint8)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffixes.suffix_array(array).tolist() == order
        same = suffixes.common_prefixes(array, suffixes.words_at(array), np.array(order), 11)
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:], text[order[k]:]
            assert same[k] == min(11, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@pytest.mark.parametrize("hot", [1, 10**6])
def test_passage_removal(spark, empty, hot):
    passage = plain.prose(70, 200, 10**6)
    texts = [None, "", "short", passage, passage[:500] + " unlike", "other " + passage[100:900] + " end é", "line here\n" * 300, passage * 2, "é" * 700, "twice " * 200, "twice " * 200]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in passages.removal(docs, hot=hot).collect()}
    want = plain.removal([(t or "").encode() for t in texts], 400)
    assert got == dict(enumerate(want))
    assert passages.removal(empty).count() == 0


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"),
        (2, 0, "system", "alone"), (None, None, None, "x"), (3, 300, "ann", "late"), (3, 1, "ann", "early"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("part", F.lit("mine"))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.perspectives(table).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", None), (3, "ann", 0), (3, "ann", 1)}
    ann = got[1, "ann", 0]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in ann["mask"].split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hi < |end|><|end|>", "bye<|end|>"] and ann.n_masked_chars == 28 and ann.n_turns == 4
    assert chat.perspectives(table.where("false")).count() == 0


def test_ids_beyond_16_bits_are_an_error(monkeypatch):
    class Wide:
        def __init__(self, top):
            self.top = top

        def encode(self, texts):
            return np.array([5, self.top], np.int64), np.array([0, 2])

    ids, texts = pa.array([1]), pa.array(["two words"])
    monkeypatch.setattr(shards, "encoder", lambda path, use: Wide(65535))
    _, out = shards.sequences(ids, texts, np.zeros(1, np.int64), "any", 50256, 8, 4, 1)
    assert out["ids"][0][:3].tolist() == [5, 65535, 50256]
    with pytest.raises(ValueError, match="16 bits"):
        shards.sequences(ids, texts, np.zeros(1, np.int64), "any", 70000, 8, 4, 1)
    monkeypatch.setattr(shards, "encoder", lambda path, use: Wide(70000))
    with pytest.raises(ValueError, match="16 bits"):
        shards.sequences(ids, texts, np.zeros(1, np.int64), "any", 50256, 8, 4, 1)

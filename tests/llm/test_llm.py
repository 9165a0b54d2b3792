"""Operators of the training-data package on small tables, against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import (
    decontamination,
    exact_dedup,
    fitting,
    language_model,
    license_scan,
    near_dedup,
    packing,
    quality,
    sharding,
    toxicity,
    warc,
)
from lodestone.llm.common import Workspace

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, shard string, _row long, score double"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "ras", "te") for b in ("ba", "do", "fen", "gi", "hol", "rum")]


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, clashing column names."""
    base = prose(1, 60)
    rows = [
        (1, base), (2, base.upper()), (3, base + " tail"), (4, prose(2, 40)), (4, prose(2, 40)),
        (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "one two"), (None, base), (None, None),
        (10, prose(3, 30_000)), (11, "ÀÉ ß <|endoftext|> ünï"), (12, prose(4, 30)),
    ]
    return spark.createDataFrame([(i, t, "x", 7, 0.5) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def low(text: str | None) -> bytes:
    return (text or "").encode().lower()


# ---------------------------------------------------------------- exact duplicates


def test_exact_duplicates(odd_docs, no_docs):
    found = exact_dedup.exact_duplicates(odd_docs, counters=2).collect()
    groups = defaultdict(list)
    for row in odd_docs.collect():
        groups[hashlib.sha256(low(row.text)).hexdigest()].append(row.doc_id)
    assert len(found) == odd_docs.count()
    kept = Counter()
    for row in found:
        ids = groups[row.text_sha256]
        known = [i for i in ids if i is not None]
        assert (row.keep_id, row.group_size) == (max(known) if known else None, len(ids))
        kept[row.text_sha256] += row.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert left.count() == len(groups)


def test_heavy_digests_have_a_bound(spark):
    rows = spark.range(4000).select(
        F.sha2(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string"), 256).cast("binary").alias("_digest")
    )
    heavy = exact_dedup.heavy_digests(rows, 20).collect()
    assert 1 <= len(heavy) <= 21
    assert hashlib.sha256(b"0").hexdigest().encode() in [bytes(r._digest) for r in heavy]


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 7, 100, 999])
def test_feistel_is_a_permutation(spark, rows):
    a, b = sharding.domain(rows)
    keys = sharding.round_keys(5)
    walk = sharding.longest_walk(spark, rows, a, b, keys)
    out = spark.range(rows).select(sharding.permuted(F.col("id"), rows, walk, a, b, keys)).collect()
    assert sorted(r[0] for r in out) == list(range(rows))


def test_shards_are_even_and_gapless(odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        rows = sharding.shuffle_into_shards(frame, ["doc_id", "text"], shards=4).collect()
        slots = defaultdict(list)
        for row in rows:
            slots[row.shard].append(row.slot)
        assert len(rows) == frame.count()
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[i]) for i in range(4)]
        assert max(sizes) - min(sizes) <= 1


def plain_permute(x: int, a: int, b: int, keys) -> int:
    from pyspark.sql import SparkSession

    row = SparkSession.active().range(1).select(sharding.permute(F.lit(x).cast("long"), a, b, keys).alias("y")).head()
    return row.y


def test_sharding_query_against_plain_values(spark):
    rows = sharding.op8_sharding(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert (r.law, r.grown_shard) == ("rows", None) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.op8_sharding(spark, SF).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    # A few places by the same permutation, one number at a time.
    ordered = sorted(texts)
    places = {r.doc_id: (r.shard, r.slot) for r in rows}
    a, b = sharding.domain(len(ordered))
    keys = sharding.round_keys(sharding.SEED)
    for number in (0, 7, len(ordered) - 1):
        place = plain_permute(number, a, b, keys)
        while place >= len(ordered):
            place = plain_permute(place, a, b, keys)
        assert places[ordered[number]] == (place % 8, place // 8)


@pytest.mark.parametrize("name", ["_place", "_tie", "_part", "_number", "_to", "_before", "_n", "slot", "c0"])
def test_shards_keep_every_column(spark, name):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(9)], f"doc_id long, {name} string")
    found = sharding.shuffle_into_shards(frame, ["doc_id"], shards=2)
    assert found.columns == (["doc_id", "shard", "slot"] if name == "slot" else ["doc_id", name, "shard", "slot"])
    if name != "slot":
        assert {r.doc_id: r[name] for r in found.collect()} == {i: f"v{i}" for i in range(9)}


def test_scores_stand_clashing_names_and_repeated_rows(spark):
    toxic = toxicity.ToxicityModel({}, np.zeros(0), np.array([2.0, 3.0]))
    added = ["toxic_probability", "expected_severity", "grade", "rejected"]
    rows = [(1, "some words", "a", 1.5, "x"), (1, "some words", "a", 1.5, "x"), (2, None, "b", 2.5, "y"), (3, "w " * 200_000, "c", 0.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string, score double, _text string")
    found = toxicity.score_toxicity(docs, "text", toxic)
    assert found.columns == ["doc_id", "text", "score", "_text", *added]
    assert sorted((r.doc_id, r.score, r._text) for r in found.collect()) == sorted((r[0], r[3], r[4]) for r in rows)
    model = quality.QualityModel(np.zeros(quality.WIDTH + 4), 0.0, 0.0)
    scored = quality.score_quality(docs, "text", model)
    assert scored.columns == ["doc_id", "text", "grade", "_text", "score"]
    assert {r.score for r in scored.collect()} == {0.5} and scored.count() == 4
    assert quality.score_quality(docs.limit(0), "text", model).count() == 0


# ---------------------------------------------------------------- benchmark passages


def plain_hits(words: list[bytes], items: dict, width: int) -> tuple[set, set]:
    hit, found = set(), set()
    for item, own in items.items():
        n = min(len(own), width)
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(40))
def test_automaton_finds_all_windows(seed):
    draw = np.random.default_rng(seed)
    letters = [b"a", b"b", b"c"]
    items = {str(i): list(draw.choice(letters, draw.integers(0, 12))) for i in range(5)}
    text = [bytes(w) for w in draw.choice([*letters, b"z"], 120)]
    automaton = decontamination.Automaton([(i, [bytes(w) for w in ws]) for i, ws in items.items()], 4)
    spans, found = automaton.find(text)
    hit, wanted = plain_hits(text, {i: [bytes(w) for w in ws] for i, ws in items.items()}, 4)
    assert {w for a, b in spans for w in range(a, b)} == hit
    assert found == wanted


def test_decontaminate(spark, odd_docs, no_docs):
    passage = prose(50, 14)
    items = spark.createDataFrame(
        [(1, passage), (2, "alpha beta"), (3, None), (4, "!!"), (None, "kaba")], "item_id long, text string"
    )
    dirty = [(20, f"{prose(3, 30)} {passage.upper()}, {prose(5, 30)}"), (21, passage), (22, "Alpha,  BETA gamma " + prose(6, 9))]
    docs = odd_docs.union(spark.createDataFrame([(i, t, "x", 7, 0.5) for i, t in dirty], DOC))
    out = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect() if r.doc_id in (20, 21, 22)}
    assert set(out) == {20, 22}
    for text in out.values():
        words = decontamination.words_of(text.encode())
        assert not plain_hits(words, {"1": decontamination.words_of(passage.encode()), "2": [b"alpha", b"beta"]}, 10)[0]
    assert out[20].startswith(prose(3, 30))
    assert out[20].endswith(prose(5, 30))
    same = decontamination.decontaminate(odd_docs, items.limit(0))
    assert Counter(same.collect()) == Counter(odd_docs.collect())
    assert decontamination.decontaminate(no_docs, items).count() == 0


def test_blocks_of_items_agree(spark, odd_docs):
    items = spark.createDataFrame([(i, prose(i, 30)) for i in range(1, 20)], "item_id long, text string")
    one = decontamination.automata(items, item_id="item_id", text="text", width=10)
    many = decontamination.automata(items, item_id="item_id", text="text", width=10, block_words=100)
    assert len(one) == 1 < len(many)
    pick = ["doc_id", "_words", "_spans", "_items"]
    left, right = (decontamination.find_items(odd_docs, "text", b).select(pick).collect() for b in (one, many))
    assert Counter(map(str, left)) == Counter(map(str, right))


# ---------------------------------------------------------------- near duplicates


def plain_sets(text: str | None, width: int) -> set:
    words = low(text).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(rows, width):
    sets = [plain_sets(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    return [(len(s), least.get(x)) for s, x in zip(sets, label, strict=True)]


def edited(base: list[str], seed: int, changes: int) -> str:
    draw, words = np.random.default_rng(seed), list(base)
    for place in draw.integers(0, len(words), changes):
        words[place] = f"new{seed}x{place}"
    return " ".join(words)


def test_near_duplicates(spark, odd_docs, no_docs):
    base = prose(70, 200).split()
    near = [(100 + i, edited(base, i, 1 + i % 14)) for i in range(150)]
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + near
    frame = spark.createDataFrame([(i, t, "x", 7, 0.5) for i, t in rows], DOC)
    found = near_dedup.near_duplicates(frame, width=4).collect()
    wanted = Counter((i, n, c) for (i, _), (n, c) in zip(rows, plain_components(rows, 4), strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == wanted
    assert near_dedup.near_duplicates(no_docs).count() == 0
    left = near_dedup.drop_near_duplicates(frame, width=4)
    assert left.columns == frame.columns
    assert Counter(r.doc_id for r in left.collect() if r.doc_id and r.doc_id >= 100) == Counter(
        {c for i, _, c in wanted if i and i >= 100}
    )


def test_odd_sketch_estimates_similarity():
    draw = np.random.default_rng(0)
    for similarity in (0.6, 0.8, 0.95):
        n = 400
        both = round(2 * n * similarity / (1 + similarity))
        values = draw.integers(0, 1 << 63, 2 * n - both, np.uint64)
        a, b = np.unique(values[:n]), np.unique(values[n - both :])
        sketches = [near_dedup.odd_sketch(near_dedup.min_hashes(s)).view(np.uint64) for s in (a, b)]
        differing = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        estimate = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.HASHES) * np.log(1 - 2 * differing / near_dedup.SKETCH_BITS)
        assert abs(estimate - similarity) < 0.12


def test_block_links_join_components():
    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(3, 103, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    rows = [{"_row": i, "label": i, "asks": True, "_set": s.tobytes()} for i, s in enumerate(sets)]
    assert near_dedup._links_of_block(rows, 80).to_pylist() == [{"a": 0, "b": 1}]
    assert near_dedup._links_of_block([], 80).num_rows == 0


# ---------------------------------------------------------------- packing


def test_plan_places_every_piece_once():
    draw = np.random.default_rng(3)
    for histogram in ({}, {1: 5}, {2048: 7}, {1000: 400, 1100: 200}, Counter(draw.integers(1, 2049, 30_000).tolist()),
                      Counter(np.minimum(2048, draw.lognormal(5, 1.2, 40_000).astype(int) + 1).tolist())):
        plan = packing.make_plan(dict(histogram))
        lengths = np.repeat(np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64))
        ranks = np.concatenate([np.arange(n) for n in histogram.values()] or [np.zeros(0, np.int64)])
        sequence, offset = plan.place(lengths, ranks)
        turn = np.lexsort((offset, sequence))
        sequence, offset, lengths = sequence[turn], offset[turn], lengths[turn]
        assert len(np.unique(sequence)) == plan.sequences
        first = np.concatenate(([True], sequence[1:] != sequence[:-1]))[: len(sequence)]
        assert (offset[first] == 0).all()
        assert (offset[1:][~first[1:]] == (offset + lengths)[:-1][~first[1:]]).all()
        assert (offset + lengths <= 2048).all()
        total = sum(k * n for k, n in histogram.items())
        if len(histogram) > 1000:
            assert plan.sequences <= 1.005 * max(total / 2048, sum(n for k, n in histogram.items() if k > 1024)) + 1


def test_fillings_are_the_best_of_all_lengths():
    draw = np.random.default_rng(5)
    for capacity in (1, 7, 40, 61):
        for _ in range(20):
            prices = np.where(draw.random(capacity + 1) < 0.4, draw.random(capacity + 1), 0.0)
            prices[0] = 0.0
            plain = [0.0] * (capacity + 1)
            for room in range(1, capacity + 1):
                plain[room] = max(
                    [plain[room - 1]] + [prices[k] + plain[room - k] for k in range(1, room + 1) if prices[k]]
                )
            best, take = packing.knapsack(prices)
            assert np.allclose(best, plain)
            for length in np.flatnonzero(prices):
                filling = packing.filling_with(int(length), take)
                assert filling[length] >= 1 and sum(k * n for k, n in filling.items()) <= capacity
                worth = sum(prices[k] * n for k, n in filling.items())
                assert abs(worth - prices[length] - plain[capacity - length]) < 1e-9


def test_plan_stays_small_when_the_table_grows():
    lengths = np.random.default_rng(1).lognormal(6, 1, 20_000).astype(int) + 1
    one = Counter(np.minimum(2048, lengths).tolist())
    plans = [packing.make_plan({k: n * times for k, n in one.items()}) for times in (1, 1000)]
    bound = sum(k * n for k, n in one.items()) / 2048
    assert plans[1].sequences <= 1.002 * 1000 * bound
    assert len(plans[1].length) < 10 * len(plans[0].length)


def test_pack(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for row in odd_docs.collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted[(row.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    rows = packing.pack(odd_docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    taken = defaultdict(list)
    for row in rows:
        taken[row.sequence_id].append((row.offset, row.length))
    for pieces in taken.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(no_docs).count() == 0


def test_fast_encoder_gives_the_tokenizer_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.public_encoder()
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert encode(row.text or "") == tokenizer.encode(row.text or "", add_special_tokens=False).ids


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark):
    long = "<p>" + "x" * 200 + "</p>"
    pages = spark.createDataFrame(
        [(3, "http://a", long), (1, "http://b\r\nWARC-Type: x", long), (2, None, "short"), (4, "http://c", "short"),
         (5, "u", None), (6, "u", ""), (1, "http://b", long), (None, "n", long), (7, "ü", "\r\n\r\n" + "é" * 90)],
        "page_id long, url string, html string",
    )
    names = []
    for _ in range(2):
        space = Workspace(spark, "warc-test")
        manifest = warc.write_archives(pages, space.path("out"), space, shard_bytes=300, file_bytes=200)
        names.append(sorted((r.file, r.sha256) for r in manifest.collect()))
    assert names[0] == names[1]
    assert len(names[0]) > 2
    rows = warc.read_archives(space.path("out"), manifest).collect()
    wanted = Counter()
    for row in pages.collect():
        payload = (row.html or "").encode()
        first = 1 if row.html == long and row.page_id not in (1, None) else None
        wanted[(row.page_id, len(payload), hashlib.sha256(payload).hexdigest(), first)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows) == wanted
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in rows)
    empty = Workspace(spark, "warc-test")
    manifest = warc.write_archives(pages.limit(0), empty.path("out"), empty)
    assert warc.read_archives(empty.path("out"), manifest).count() == 0


# ---------------------------------------------------------------- language model


def plain_model(texts: list[bytes]):
    order, trie = language_model.ORDER, defaultdict(Counter)
    for text in texts:
        padded = bytes(order) + text + b"\xff"
        for i in range(order, len(padded)):
            for n in range(order + 1):
                trie[padded[i - n : i]][padded[i]] += 1

    def score(text: bytes) -> float:
        padded, total = bytes(order) + text + b"\xff", 0.0
        for i in range(order, len(padded)):
            out: set = set()
            for n in range(order, -1, -1):
                seen = {b: k for b, k in trie.get(padded[i - n : i], {}).items() if b not in out}
                counts = sum(seen.values())
                if padded[i] in seen:
                    total += np.log10((2 * seen[padded[i]] - 1) / (2 * counts))
                    break
                if seen:
                    total += np.log10(len(seen) / (2 * counts))
                out |= set(seen)
            else:
                total -= np.log10(256 - len(trie.get(b"", {})))
        return total

    return score


def test_language_model(odd_docs, no_docs):
    training = F.col("doc_id") % 3 != 0
    rows = odd_docs.filter("doc_id is null or doc_id <> 10").select("doc_id", "text", "score")
    found = language_model.score_documents(rows, training).collect()
    texts = [(r.doc_id, low(r.text)) for r in rows.collect()]
    learnt = [t for i, t in texts if i is not None and i % 3 != 0]
    counts = Counter(w for t in learnt for w in [*t.split(), None])
    size, kinds = sum(counts.values()), len(counts)
    score = plain_model(learnt)
    wanted = Counter()
    for i, text in texts:
        tokens = [*text.split(), None]
        base = sum(np.log10((counts[w] + 1) / (size + kinds + 1)) for w in tokens)
        known = sum(counts[w] > 0 for w in tokens)
        wanted[(i, len(tokens), known, size, round(base, 6), round(score(text), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == wanted
    assert language_model.score_documents(no_docs, training).count() == 0
    unlearnt = language_model.score_documents(rows, F.lit(False)).collect()
    even = sorted(round(r.score, 6) for r in unlearnt)
    assert even == sorted(round(-np.log10(256) * (len(t) + 1), 6) for _, t in texts)


def test_probabilities_of_a_context_sum_to_one():
    texts = [b"abracadabra", b"abra cadabra", b"banana"]
    keys = np.concatenate([language_model.context_keys([t])[0] for t in texts])
    levels = []
    for order in range(language_model.ORDER + 1):
        levels.append(np.unique(keys & np.uint64((1 << (8 * (order + 1))) - 1), return_counts=True))
    orders = language_model.build_trie(levels)
    for context in (b"\0\0\0\0\0", b"\0abra", b"zzzzz", b"zzabr", b"anana"):
        ends = np.array([int.from_bytes(context + bytes([b])) for b in range(256)], np.uint64)
        assert abs((10 ** language_model.code_lengths(orders, ends)).sum() - 1) < 1e-9


def test_no_context_is_cut(spark):
    draw = np.random.default_rng(5)
    texts = [bytes(draw.integers(97, 123, 20_000, np.uint8)).decode() for _ in range(50)]
    texts.append("".join(t[100:150] for t in texts) + "?!")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in language_model.score_documents(rows, F.col("doc_id") < 50).collect()}
    keys = np.concatenate([language_model.context_keys([low(t)])[0] for t in texts[:50]])
    levels = []
    for order in range(language_model.ORDER + 1):
        levels.append(np.unique(keys & np.uint64((1 << (8 * (order + 1))) - 1), return_counts=True))
    assert len(levels[-1][0]) > 900_000
    orders = language_model.build_trie(levels)
    for i in (0, 49, 50):
        wanted = language_model.code_lengths(orders, language_model.context_keys([low(texts[i])])[0]).sum()
        assert abs(found[i] - wanted) < 1e-6 * abs(wanted)


# ---------------------------------------------------------------- fitted models


def numeric(loss, weights):
    out = np.zeros(len(weights))
    for i in range(len(weights)):
        step = np.zeros(len(weights))
        step[i] = 1e-5
        out[i] = (loss(weights + step)[0] - loss(weights - step)[0]) / 2e-5
    return out


def test_minimise_reaches_the_minimum():
    scale = np.array([1.0, 30.0, 4.0])
    weights = fitting.minimise(lambda w: (float((scale * (w - 2) ** 2).sum()), 2 * scale * (w - 2)), np.zeros(3), passes=60)
    assert np.abs(weights - 2).max() < 1e-2


def test_ordinal_gradient():
    draw = np.random.default_rng(1)
    grades, owner, at = draw.integers(0, 3, 20), np.repeat(np.arange(20), 3), draw.integers(0, 5, 60)
    value = draw.random(60)
    weights = draw.normal(size=7)

    def loss(w):
        return toxicity.ordinal_loss(grades, owner, at, value, w, 5)

    assert np.abs(loss(weights)[1] - numeric(loss, weights)).max() < 1e-4


def test_field_gradient_and_marginals():
    draw = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 4])
    features, labels = draw.normal(size=(8, quality.WIDTH)), draw.integers(0, 2, 8)
    weights = draw.normal(size=quality.WIDTH + 4) * 0.3

    def loss(w):
        return quality.field_loss(features, counts, labels, w)

    assert np.abs(loss(weights)[1] - numeric(loss, weights)).max() < 1e-4
    scores, change = features @ weights[: quality.WIDTH], weights[quality.WIDTH :].reshape(2, 2)
    log_z, bad, _ = quality.marginals(scores, counts, change)
    own = scores[4:8]  # all 16 labellings of the last document
    total, marked = 0.0, np.zeros(4)
    for code in range(16):
        states = [(code >> i) & 1 for i in range(4)]
        mass = np.exp(own @ states + sum(change[a, b] for a, b in zip(states, states[1:], strict=False)))
        total += mass
        marked += mass * np.array(states)
    assert abs(np.log(total) - log_z[3]) < 1e-9
    assert np.abs(marked / total - bad[4:8]).max() < 1e-9


def test_toxicity_on_planted_words(spark, no_docs):
    rows = [(i, prose(i, 30) + (" vile scum" if i % 5 == 0 else ""), "x", 7, 0.5) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "x", 7, 0.5), (901, "", "x", 7, 0.5)], DOC)
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(0, 160)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int"
    )
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i in range(200) if i % 5} | {900, 901}
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(no_docs.drop("score"), "text", model).count() == 0
    assert (np.diff(model.cuts) > 0).all()
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_quality_on_planted_lines(spark, no_docs):
    good = [(i, "\n".join(prose(i * 9 + k, 12).capitalize() + "." for k in range(5))) for i in range(120)]
    bad = [(500 + i, good[i][1] + "\n" + " | ".join(prose(i, 30).upper().split()) + "!!") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (900, None), (901, "\n \n")], "doc_id long, text string")
    labels = docs.filter("doc_id % 4 <> 0").select("doc_id", (F.col("doc_id") < 500).cast("int").alias("quality"))
    model = quality.fit_quality(docs, labels.union(spark.createDataFrame([(None, 1), (2, None)], labels.schema)))
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, "text", model).collect()}
    held = [i for i in scores if i % 4 == 0 and i < 900]
    assert all((scores[i] >= 0.3) == (i < 500) for i in held)
    assert all(0 <= s <= 1 for s in scores.values())
    assert quality.score_quality(no_docs.select("doc_id", "text"), "text", model).count() == 0
    blank = quality.fit_quality(docs, labels.limit(0))
    assert abs(blank.scores([b"x"])[0] - 0.5) < 1e-6


# ---------------------------------------------------------------- licences


def test_licences_and_inheritance(spark, no_docs):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("src/LICENSE", mit), ("src/a/b/x.txt", prose(1, 20)), ("src/a/LICENSE", apache), ("src/a/y.txt", prose(2, 20)),
        ("src/z.txt", prose(3, 50) + "\n" + apache), ("other/q.txt", prose(4, 20)), ("other/w.txt", None), (None, ""),
        ("src/a/y.txt", prose(2, 20)), ("top.txt", prose(5, 9)),
    ]
    files = spark.createDataFrame([(p, t, "clash", 3) for p, t in rows], "path string, text string, licence string, _row long")
    found = license_scan.scan(files)
    got = {(r.path, r.licence, r.licence_from, r.licence_directory) for r in found.collect()}
    assert found.count() == len(rows)
    assert got == {
        ("src/LICENSE", "MIT", "file", None), ("src/a/b/x.txt", "Apache-2.0", "directory", "src/a"),
        ("src/a/LICENSE", "Apache-2.0", "file", None), ("src/a/y.txt", "Apache-2.0", "directory", "src/a"),
        ("src/z.txt", "Apache-2.0", "header", None), ("other/q.txt", None, "none", None),
        ("other/w.txt", None, "none", None), (None, None, "none", None), ("top.txt", None, "none", None),
    }
    assert license_scan.scan(no_docs.withColumn("path", F.lit("a/b"))).count() == 0


def test_telling_words_lose_no_line():
    statements = license_scan._statements(license_scan.TEMPLATES)
    words = {w for _, _, counts in statements for w in counts}
    draw = np.random.default_rng(0)
    idf = {w: 1 + 5 * draw.random() for w in sorted(words)}
    telling = license_scan.telling_words(statements, idf, 0.6)
    for _, _, counts in statements:
        rest = sum((n * idf[w]) ** 2 for w, n in counts.items() if w not in telling)
        assert rest < 0.36 * sum((n * idf[w]) ** 2 for w, n in counts.items())
    assert re.fullmatch("[a-z0-9]+", next(iter(telling)))

"""Operators 1, 2, 4, 6, 8, 9 and 10."""

import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plain  # noqa: F401
from tidelog.llm import chat, decontaminate, fingerprints, quality, queries, sentencepiece_codec, sharding, token_shards
from tidelog.llm._text import buffers, gram_hashes, range_hash, word_bounds, word_hashes

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- kernels


def test_words_are_those_of_split():
    texts = ["", None, " a  bb\n", "x", "é ü\tß", "\r\n", "a" * 50]
    data, offsets = buffers(pa.array(texts))
    starts, ends, per = word_bounds(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[per[k] : per[k + 1]], ends[per[k] : per[k + 1]])] for k in range(len(texts))]
    assert got == [(t or "").split() for t in texts]
    same = range_hash(*buffers(pa.array(["xx ab ab"]))[:1], np.array([3, 6]), np.array([5, 8]))
    assert same[0] == same[1]
    words, per = word_hashes(*buffers(pa.array(["a b c d", "b c d", "a b", ""])))
    grams, at = gram_hashes(words, per, 3)
    assert list(np.diff(at)) == [2, 1, 1, 0] and grams[1] == grams[2] != grams[0]


# --- 1


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)


def reference_pieces(sp, text):
    return [(p.id, p.begin, p.end) for p in sp.encode(text, return_type="proto").pieces]


def test_encoding_equals_the_library_and_round_trips(spark, make, small, hard_rows, library):
    docs = make(hard_rows, extra=True).select("doc_id", "text", "piece_ids").unionByName(small.select(F.col("doc_id") + 100, "text", F.lit(1)).toDF("doc_id", "text", "piece_ids"))
    rows = sentencepiece_codec.encode(docs).collect()
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == sum(want.values())
    texts = defaultdict(set)
    for d, t in want:
        texts[d].add(t)
    for r in rows:
        if r.piece_ids is None:
            assert None in texts[r.doc_id] and r.n_pieces is None and r.lossless is None
            continue
        got = list(zip(r.piece_ids, r.span_starts, r.span_ends))
        (t,) = texts[r.doc_id]
        assert got == reference_pieces(library, t) and r.n_pieces == len(got) and r.lossless == ("▁" not in t)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter({(d, t and t.replace("▁", " ")): n for (d, t), n in want.items()})
    assert sentencepiece_codec.encode(make([])).count() == 0 and sentencepiece_codec.decode(sentencepiece_codec.encode(make([]))).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_maps(tmp_path, rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    made = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    with open(sentencepiece_codec.MODEL, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.normalizer_spec.CopyFrom(made.normalizer_spec)
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, squeeze, True
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
    texts = ["ﬁne  Ａｂｃ ①½ é が  x　y\tz \n", " ​ ", "ｶﾞ ㌔ \u0001a­  ", "", "x ", "  a  b", "゛ ゜", "😀 ﷺ"]
    ids, start, end, per = codec.encode_flat(*buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert list(zip(*(x[per[k] : per[k + 1]].tolist() for x in (ids, start, end)))) == reference_pieces(sp, t), t


def test_decoding_refuses_bad_ids(spark):
    frame = lambda ids: spark.createDataFrame([(1, ids)], "doc_id bigint, piece_ids array<int>")
    assert sentencepiece_codec.decode(frame(None)).first().text is None
    for bad in ([40000], [-1], [5, None]):
        with pytest.raises(Exception):
            sentencepiece_codec.decode(frame(bad)).collect()


# --- 2


def test_token_shards(spark, make, small, hard_rows, tmp_path):
    import tiktoken

    with open(token_shards.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain_encoder = tiktoken.Encoding("own", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = make(hard_rows, extra=True).select("doc_id", "text", "slot").unionByName(small.select("doc_id", "text", F.lit(1).alias("slot")).withColumn("doc_id", F.col("doc_id") + 100))
    ordered = token_shards.training_order(docs, length=64, per_shard=500)
    rows = ordered.collect()
    n = len(rows)
    assert [r.slot for r in rows] == list(range(n)), "range-partitioned and sorted, each slot once"
    assert all(r.shard == r.slot // 500 and r.byte_offset == r.slot % 500 * 128 and len(r.tokens) == 128 for r in rows)
    whole, pads = defaultdict(list), 0
    for r in rows:
        tokens = np.frombuffer(r.tokens, "<u2").tolist()
        starts = [p.start for p in r.docs] + [r.n_tokens]
        assert starts[0] == 0 and starts == sorted(set(starts)) and set(tokens[r.n_tokens :]) <= {len(ranks)}
        pads += r.n_tokens < 64
        for p, a, b in zip(r.docs, starts, starts[1:]):
            whole[p.doc].append((p.token, tokens[a:b]))
    assert pads <= docs.rdd.getNumPartitions(), "only a task's last sequence is padded"
    joined = {d: sum((t for _, t in sorted(ps, key=lambda p: p[0])), []) for d, ps in whole.items()}
    for r in docs.collect():
        if r.text is None:
            assert r.doc_id not in whole
        elif r.doc_id != 5:
            assert joined[r.doc_id] == [*plain_encoder.encode_ordinary(r.text), len(ranks)]
            at = 0
            for token, piece in sorted(whole[r.doc_id], key=lambda p: p[0]):
                assert token == at
                at += len(piece)
    assert sorted(t for _, ps in whole[5] for t in ps) == sorted(2 * [*plain_encoder.encode_ordinary("same row here"), len(ranks)])
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        files = token_shards.materialised(docs, 64, 500, folder=folder).collect()
        assert [r.slot for r in files] == list(range(n)) and all(r.path == token_shards.shard_path(folder, r.shard) for r in files)
        tail = list(token_shards.read_from(folder, n // 2, 64, 500))
        assert [t.tobytes() for t in tail] == [bytes(r.tokens) for r in rows[n // 2 :]]
    assert token_shards.training_order(make([])).count() == 0 and token_shards.materialised(make([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = token_shards.feistel(np.arange(n), n, 99)
    assert sorted(got) == list(range(n))
    assert n < 1000 or (got != token_shards.feistel(np.arange(n), n, 98)).mean() > 0.9


# --- 4


def slow_level(symbols):
    """One level of locally consistent parsing, a symbol at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        x &= mask
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    runs, k = [], 0
    while k < len(symbols):
        j = k
        while j < len(symbols) and symbols[j] == symbols[k]:
            j += 1
        runs.append(symbols[k] if j - k == 1 else mix(symbols[k] * 0xA0761D6478BD642F + (j - k)))
        k = j
    label = runs
    for _ in range(4):
        new = []
        for i, x in enumerate(label):
            diff = x ^ (label[i - 1] if i else ~x & mask)
            place = (diff & -diff).bit_length() - 1
            new.append(2 * place + (x >> place & 1))
        label = new
    cut = [0]
    for i in range(1, len(runs)):
        if label[i] > label[i - 1] and (i + 1 == len(runs) or label[i] > label[i + 1]) and i > 1:
            cut.append(i)
    out = []
    for a, b in zip(cut, [*cut[1:], len(runs)]):
        total = sum(mix(runs[i] + (i - a + 1) * 0xE7037ED1A0B428DB) for i in range(a, b))
        out.append(mix(total + (b - a) * 0xE7037ED1A0B428DB))
    return out


def test_fingerprints_equal_the_slow_parse(make, small, hard_rows):
    docs = make(hard_rows, extra=True).select("doc_id", "text", "name").unionByName(small.limit(40).select(F.col("doc_id") + 100, "text", F.lit(1)).toDF("doc_id", "text", "name"))
    rows = fingerprints.fingerprints(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        t = texts[r.doc_id][0]
        if t is None:
            assert r.n_words is r.fingerprint is r.phrases is None
            continue
        symbols = [int(x) for x in word_hashes(*buffers(pa.array([t])))[0]]
        assert r.n_words == len(symbols)
        if not symbols:
            assert r.fingerprint is None and r.phrases == []
            continue
        levels = [slow_level(symbols)]
        while len(levels[-1]) > 1:
            levels.append(slow_level(levels[-1]))
        assert r.fingerprint % 2**64 == levels[-1][0] and r.levels == len(levels)
        second = levels[1] if len(levels) > 1 else slow_level(levels[0])
        assert [p % 2**64 for p in r.phrases] == second
    assert fingerprints.fingerprints(make([])).count() == 0


def test_equal_passages_share_phrases(make):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(300)]
    docs = make([(k, " ".join([word() for _ in range(k * 7)] + passage + [word() for _ in range(30)])) for k in range(4)])
    sets = [set(r.phrases) for r in fingerprints.fingerprints(docs).collect()]
    assert all(len(sets[0] & s) >= 30 for s in sets[1:])


# --- 6


@pytest.mark.parametrize("n, cell", [(6, 256), (12, 5)])
def test_sharding_equals_a_plain_packing(spark, make, hard_rows, n, cell):
    draw = random.Random(9)
    # s2 holds a third of the rows; rows 600 to 603 tie, and the last one is more than a shard
    rows = [(k, "w " * draw.randint(1, 60), draw.choice(["en", "de", None]), f"s{min(k % 11, k % 3)}", 0) for k in range(600)]
    rows += [(600 + k, "tie tie", None, f"t{k}", 0) for k in range(4)] + [(604, "big " * 4000, "en", "huge", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit(1), "unit": F.lit("x")})
    out = sharding.shard_documents(docs, n_shards=n, cell_shards=cell)
    got = {r.doc_id: r.shard for r in out.collect()}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    names = {r.doc_id: r.j for r in docs.select("doc_id", F.to_json(F.struct(F.col("source").alias("g0"), F.col("lang").alias("g1"))).alias("j")).collect()}
    size = {r[0]: np.array([len(r[1]), len(r[1].split()), 1.0]) for r in rows}
    total = sum(size.values())
    groups = defaultdict(lambda: np.zeros(3))
    for d in size:
        groups[names[d]] += size[d]
    parts = {g: max(1, int(np.ceil((v * n / total).max() / 0.125))) for g, v in groups.items()}
    unit_of = {d: f"{names[d]}#{hashes[d] % parts[names[d]]}" for d in size}
    units = defaultdict(lambda: np.zeros(3))
    for d in size:
        units[unit_of[d]] += size[d]
    cells = -(-n // cell)
    cell_of = {r.u: r.c for r in spark.createDataFrame([(u,) for u in units], "u string").select("u", F.pmod(F.xxhash64("u"), F.lit(cells)).alias("c")).collect()}
    where = {}
    for c in range(cells):
        own = [u for u in units if cell_of[u] == c]
        low, high = n * c // cells, n * (c + 1) // cells
        whole = sum((units[u] for u in own), np.zeros(3))
        room = [np.full(3, 1.02) for _ in range(high - low)]
        for u in sorted(own, key=lambda u: (-(units[u] / whole).max(), u)):
            v = units[u] / (whole / (high - low))
            fit = [s for s in range(high - low) if (room[s] >= v - 1e-12).all()]
            best = max(fit, key=lambda s: (room[s] @ v, -s)) if fit else max(range(high - low), key=lambda s: ((room[s] - v).min(), -s))
            where[u] = best + low
            room[best] = room[best] - v
    assert got == {d: where[unit_of[d]] for d in size}
    assert sharding.shard_documents(make(hard_rows, extra=True)).count() == len(hard_rows)
    assert sharding.shard_documents(make([])).count() == 0


def test_shards_follow_the_size(make):
    docs = make([(k, "word " * 200) for k in range(300)])
    load = defaultdict(int)
    for r in sharding.shard_documents(docs, shard_bytes=30_000).collect():
        load[r.shard] += r.bytes
    assert len(load) == 10 and max(load.values()) < 1.25 * 30_000


# --- 8


def test_ranker_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality.train(docs, labels, most_labelled=3000)
    assert ranker.pair_accuracy > 0.97
    known = labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").offset(3000)
    judged = quality.scored(docs, ranker).join(known, "doc_id").join(labels, "doc_id").collect()
    good = [r.keep for r in judged if r.quality == 1 and r.toxic == 0]
    poor = [r.keep for r in judged if r.quality == 0]
    toxic = [r.keep for r in judged if r.toxic == 1]
    assert len(good) > 100 and np.mean(good) > 0.97 and np.mean(poor) < 0.05 and np.mean(toxic) < 0.1


def test_scores_are_the_sum_of_weights(make, hard_rows):
    draw = np.random.default_rng(1)
    hashed = np.where(draw.random(1 << quality.BITS) < 0.5, draw.normal(size=1 << quality.BITS), 0).astype(np.float32)
    ranker = quality.Ranker(draw.normal(size=quality.DENSE), hashed, 0.0, 1, 1, 0)
    docs = make(hard_rows, extra=True)
    rows = quality.scored(docs, ranker).collect()
    assert len(rows) == len(hard_rows)
    for r in rows:
        text = next(t for i, t in hard_rows if i == r.doc_id)
        if text is None:
            assert r.score is None and r.keep is False
            continue
        dense, present, _ = quality.features(pa.array([text]))
        want = float(dense[0] @ ranker.dense) + float(hashed[np.unique(present)].astype(float).sum())
        assert abs(r.score - want) < 1e-5 and r.keep == (r.score >= 0)
    stay = quality.kept(docs, ranker)
    assert stay.columns == docs.columns and stay.count() == sum(r.keep for r in rows)


def brute_dense(text):
    """The dense measures from their definitions, in plain Python."""
    low = text.lower()
    words = []
    for w in filter(None, re.split(r"[ \t\n\x0b\f\r]+", low)):
        for _ in range(2):
            if len(w.encode()) > 1 and w[-1] in ".,;:!?\"'()":
                w = w[:-1]
        words.append(w)
    raw, n = text.encode(), max(len(words), 1)
    of = lambda chars: sum(chr(c) in chars for c in raw) / max(len(raw), 1)
    symbols = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in ".,;:'\"!?-()")
    upper, digit, mark, stop = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("0123456789"), of(symbols), of(".,;:!?")
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [tuple(words)] * bool(words)
    return [1, np.log1p(len(words)), len(text.lower().encode()) / n / 10, stutter, upper, digit, mark, stop, min(upper * 5, 1), min(stutter * 20, 1), min(mark * 50, 1), min(stop * 50, 1), sum(len(w.encode()) == 1 for w in words) / n, (len(runs) - len(set(runs))) / max(len(runs), 1)]


def test_features_against_brute_force_in_any_company(small, hard_rows):
    texts = [t for _, t in hard_rows if t is not None] + ["spam", "spam", "spam spam (spam)."] + [r.text for r in small.collect()]
    dense, present, per = quality.features(pa.array(texts))
    names = {}
    for k, t in enumerate(texts):
        alone = quality.features(pa.array([t]))
        assert (alone[0][0] == dense[k]).all() and (alone[1] == present[per[k] : per[k + 1]]).all()
        assert np.allclose(dense[k], brute_dense(t), atol=1e-12)
        if len(t) < 400:  # the hashed features of a text are those of its words, taken one by one
            own = set(filter(None, re.split(r"[ \t\n\x0b\f\r]+", t)))
            for w in own - set(names):
                names[w] = set(quality.features(pa.array([w]))[1].tolist())
            assert set(present[per[k] : per[k + 1]].tolist()) == set().union(*(names[w] for w in own))


def test_fit_is_at_the_least_loss():
    """Beside the pair loss of every pair, computed one by one, moving any weight that was learned doesn't help."""
    texts, good = fair_and_poor(80, set(range(0, 80, 3))), np.array([k % 3 > 0 for k in range(80)])
    ranker = quality.fit(*quality.features(pa.array(texts)), good)
    s = ranker.score(pa.array(texts))
    loss = lambda v: np.mean([np.log1p(np.exp(b - a)) for a in v[good] for b in v[~good]])
    assert loss(s) < 0.1 and abs(loss(s * 0) - np.log(2)) < 1e-9
    dense = quality.features(pa.array(texts))[0]
    for k in np.flatnonzero(ranker.dense):
        assert loss(s) <= loss(s - ranker.dense[k] * dense[:, k]) + 1e-3


def test_labels_that_repeat_and_texts_that_repeat(spark, make):
    rows = list(enumerate(fair_and_poor(60, set(range(0, 60, 4)))))
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    once = quality.train(make(rows), labels)
    again = quality.train(make(rows * 3 + [(1, "zz " * 300_000)]), labels.union(labels))
    assert again.threshold == once.threshold and (again.hashed == once.hashed).all() and (again.dense == once.dense).all()
    long = quality.train(make(rows + [(60, "zz yy " * 150_000)]), labels.union(spark.createDataFrame([(60, 0, 0)], labels.schema)))
    assert [r.keep for r in quality.scored(make([(60, "zz yy " * 150_000)]), long).collect()] == [False]


def test_no_pairs_keep_all_texts(spark, make, hard_rows):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = quality.classify(make(hard_rows), known).collect()
        assert sum(r.keep for r in rows) == sum(t is not None for _, t in hard_rows)
    assert quality.classify(make([]), labels).count() == 0


def fair_and_poor(n, poor):
    draw = random.Random(4)
    fair = lambda: " ".join(draw.choice(("river", "stone", "music", "garden", "letter", "winter", "reads", "walks", "slowly", "and")) for _ in range(draw.randint(20, 60)))
    return [" ".join(["BUY!!!", "pills", "|", "$$$", "now"] * draw.randint(4, 9)) if k in poor else fair() for k in range(n)]


def test_few_of_a_kind_are_told_apart():
    for n, poor in ((200, {7}), (200, {7, 90}), (200, {3, 4, 150}), (2, {1}), (30, set(range(30)) - {5})):
        texts, good = fair_and_poor(n, poor), np.array([k not in poor for k in range(n)])
        for seed in range(4):
            ranker = quality.fit(*quality.features(pa.array(texts)), good, seed=seed)
            keep = ranker.score(pa.array(texts)) >= ranker.threshold
            assert not keep[~good].any() and keep[good].mean() > 0.95
    assert quality.fit(*quality.features(pa.array(texts)), np.ones(n, bool)).threshold == -np.inf


def test_sample_holds_both_kinds(spark, make):
    # the poor documents are those whose hashed ids come last, outside a sample of the first ones
    order = [r.id for r in spark.range(400).orderBy(F.xxhash64("id"), "id").collect()]
    poor = set(order[-6:])
    labels = spark.createDataFrame([(k, int(k not in poor), 0) for k in range(400)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(make(list(enumerate(fair_and_poor(400, poor)))), labels, most_labelled=80).collect()
    assert not any(r.keep for r in rows if r.doc_id in poor) and np.mean([r.keep for r in rows if r.doc_id not in poor]) > 0.95


def test_all_labelled_documents_are_learned_from(spark, make):
    # what tells the last poor documents is in no document whose hashed id is among the first ones
    order = [r.id for r in spark.range(400).orderBy(F.xxhash64("id"), "id").collect()]
    poor, late, draw = set(order[:20]), set(order[-20:]), random.Random(9)
    texts = fair_and_poor(400, poor)
    for k in late:
        texts[k] = " ".join(draw.choice(("riven", "store", "mural", "gavel", "lotus", "winged", "ready", "wakes", "sleepy", "any")) for _ in range(draw.randint(20, 60)))
    labels = spark.createDataFrame([(k, int(k not in poor | late), 0) for k in range(400)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(make(list(enumerate(texts))), labels, most_labelled=80).collect()
    assert np.mean([r.keep for r in rows if r.doc_id in late]) < 0.1 and np.mean([r.keep for r in rows if r.doc_id not in poor | late]) > 0.95


@pytest.mark.parametrize("common, rare, most", [(100, 50, 12_000), (394, 6, 80), (1_000_000, 3000, 12_000), (7000, 6000, 1000), (5, 1, 2), (10_000_000, 1, 12_000)])
def test_parts_of_the_labelled_documents(common, rare, most):
    parts, blocks = quality._blocks(common, rare, most)
    assert parts >= blocks >= 1 and common / parts + rare / blocks <= max(most, 2) + 1
    assert rare / blocks >= min(rare, most // 8) / 2


def test_packed_features_come_back():
    dense, present, per = quality.features(pa.array(fair_and_poor(40, {3, 8}) + ["", None]))
    packed = pa.table({"dense": [d.tobytes() for d in dense], "present": quality._packed(present, per)})
    got = quality._unpacked(packed.slice(2, 30))
    assert (got[0] == dense[2:32]).all() and (got[1] == present[per[2] : per[32]]).all() and (got[2] == per[2:33] - per[2]).all()


# --- 9


def test_chat_examples(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (1, 2, "assistant", "A"), (1, 3, None, "x"), (1, 4, "assistant", "B"), (1, 5, "assistant", None), (1, 5, "assistant", ""), (1, 6, "assistant", "C"), (None, 0, "assistant", "n"), (2, None, "assistant", "n"), (3, 0, "assistant", "first"), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"at": F.lit(1), "target": F.lit(2), "turns": F.lit(3), "prompt": F.lit(4)})
    got = {(r.conv_id, r.target_turn): r for r in chat.prefix_targets(df).collect()}
    assert set(got) == {(1, 2), (1, 4), (1, 6), (3, 0)}
    assert got[1, 4].prompt == "<|system|>\nS\n<|user|>\nU\n<|assistant|>\nA\n<||>\nx\n<|assistant|>\n" and got[1, 4].completion == "B"
    assert got[1, 6].n_context == 7 and got[3, 0].prompt == "<|assistant|>\n"
    for r in got.values():
        assert (r.prompt + r.completion)[r.train_from : r.train_to] == r.completion
    assert chat.prefix_targets(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} " * 3) for k in range(400)] + [(8, 0, "user", "x" * 200_000), (8, 1, "assistant", "y" * 200_000)]
    got = {(r.conv_id, r.target_turn): r for r in chat.prefix_targets(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(got) == 201 and got[7, 399].n_context == 399
    prompt = "".join(f"<|{r}|>\n{t}\n" for c, k, r, t in rows if c == 7 and k < 399) + "<|assistant|>\n"
    assert got[7, 399].prompt == prompt and got[8, 1].completion == "y" * 200_000


# --- 10


def weighted_jaccard(window, item, weight):
    """What the item hasn't got weighs as a shingle of a single item, ``weight(None)``."""
    of = {k: weight(k) if k in item else weight(None) for k in set(window) | set(item)}
    return sum(w * min(window[k], item[k]) for k, w in of.items()) / sum(w * max(window[k], item[k]) for k, w in of.items())


def brute_contaminations(docs, items, threshold=0.6):
    """Every item against every window of its size."""
    grams = lambda w: Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else Counter([tuple(w)])
    bags = {i: (t.lower().split(), grams(t.lower().split())) for i, t in items if t and t.split()}
    df = Counter(g for _, bag in bags.values() for g in bag)
    weight = lambda g: np.log1p(len(bags) / df[g]) if g in df else np.log1p(len(bags))
    out = set()
    for d, t in docs:
        words = (t or "").lower().split()
        every = set(grams(words)) if words else set()
        for i, (w, bag) in bags.items():
            if len(w) <= len(words) and (len(w) < 3 or every & set(bag)):
                if max(weighted_jaccard(grams(words[k : k + len(w)]), bag, weight) for k in range(len(words) - len(w) + 1)) >= threshold:
                    out.add((d, i))
    return out


def test_contaminations_against_brute_force(spark, make, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    draw = random.Random(2)
    rows = [(r.doc_id, r.text) for r in small.collect() if len(r.text) < 6000]
    filler = rows[0][1].split()[:80]
    for k, (_, t) in enumerate(items):  # near copies with up to three words changed
        words = t.split()
        for _ in range(k % 4):
            words[draw.randrange(len(words))] = "changed"
        rows.append((10_000 + k, " ".join(filler[: k * 2] + words + filler)))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"doc_id": F.lit(1), "similarity": F.lit(2)})
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(make(rows, extra=True).drop("item_id"), bench).collect()}
    want = brute_contaminations(rows, items)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 30
    left = {r.doc_id for r in decontaminate.clean(make(rows), bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_contamination_edges(spark, make, hard_rows):
    bench = spark.createDataFrame([(1, "same row here"), (2, None), (3, ""), (None, "x"), (4, "word"), (5, "go go")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(make(hard_rows), bench).collect()}
    assert {(5, 1), (6, 4), (8, 5)} <= got
    assert decontaminate.clean(make(hard_rows), bench).where("doc_id in (5, 6, 8)").count() == 0
    assert decontaminate.contaminations(make(hard_rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminations(make([]), bench).count() == 0
    assert decontaminate.clean(make(hard_rows), bench.limit(0)).count() == len(hard_rows)


def brute_short(docs, items, threshold=0.6):
    """Every item against every document of fewer words, whole."""
    bag = lambda w: Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    bags = {i: bag(t.lower().split()) for i, t in items}
    df = Counter(g for b in bags.values() for g in b)
    weight = lambda g: np.log1p(len(bags) / df.get(g, 1))
    size = {i: len(t.split()) for i, t in items}
    return {(d, i) for d, t in docs for i, b in bags.items() if 3 <= len(t.split()) < size[i] and weighted_jaccard(bag(t.lower().split()), b, weight) >= threshold}


def test_documents_shorter_than_the_item(spark, make):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        rows += [(10 * k, " ".join(w[:-1])), (10 * k + 1, " ".join(w[3:])), (10 * k + 2, " ".join(w[:9] + w[10:])), (10 * k + 3, " ".join(w[: len(w) // 2]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminations(make(rows), bench).collect()
    got, want = {(r.doc_id, r.item_id) for r in found}, brute_short(rows, items)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 2 * len(items)
    texts = dict(rows)
    assert all(r.start_word == 0 and r.n_words == len(texts[r.doc_id].split()) for r in found)
    left = {r.doc_id for r in decontaminate.clean(make(rows), bench).collect()}
    assert left == set(texts) - {d for d, _ in got}


def test_other_punctuation_is_the_same_passage(spark, make):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [(-1, "?! -- ...")]
    bare = str.maketrans("", "", "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
    strip = lambda t: " ".join(t.translate(bare).split())
    rows, filler = [(-1, "so ?! -- ... it"), (-2, "so it - ?!")], "zz yy xx - ww " * 30
    for k, (_, t) in enumerate(items[:-1]):
        w = t.split()
        forms = [strip(t), t.replace(",", ""), " - ".join(w), "; ".join(w), " ".join(w[:9] + w[10:]).upper() + " !"]
        rows += [(20 * k + 2 * c + own, f if own else f"{filler}{f} {filler}") for c, f in enumerate(forms) for own in (0, 1)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminations(make(rows), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    plain_items, plain_rows = [(i, strip(t)) for i, t in items[:-1]], [(d, strip(t)) for d, t in rows]
    want = brute_contaminations(plain_rows, plain_items) | brute_short(plain_rows, plain_items) | {(-1, -1)}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 10 * len(items) - 10
    texts, whole = dict(rows), dict(items)
    for r in found:  # positions are those of the text as it is written
        passage = texts[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
        assert len(passage) == r.n_words and (r.similarity < 1 or strip(" ".join(passage)).lower() == strip(whole[r.item_id]).lower())
    assert sum(r.similarity == 1 for r in found) >= 8 * (len(items) - 1)
    assert {r.doc_id for r in decontaminate.clean(make(rows), bench).collect()} == set(texts) - {d for d, _ in got}


def test_parts_of_the_benchmark_change_nothing(spark, make):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(14)]  # shingles that all items share weigh less than their own
    items = [(k, " ".join([word() for _ in range(8)] + common + [word() for _ in range(8)])) for k in range(60)] + [(100, "?! -- ..."), (101, "!! ?? --"), (102, "")]
    rows = []
    for k, t in items[:60]:
        w = t.split()
        for _ in range(k % 7):
            w[draw.randrange(len(w))] = word()
        rows.append((k, " ".join(common[: k % 9] + w + common)))
    rows += [(200, "so ?! -- ... it")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.contaminations(make(rows), bench, most_bytes=1 << 62).collect()))
    assert 20 < len(whole) < 60
    for most in (900, 4000):
        assert sorted(map(tuple, decontaminate.contaminations(make(rows), bench, most_bytes=most).collect())) == whole
    want = brute_contaminations(rows[:60], items[:60])
    assert {w[:2] for w in whole if w[0] < 100} == want
    left = {d for d, _ in rows} - {w[0] for w in whole}
    assert {r.doc_id for r in decontaminate.clean(make(rows), bench, most_bytes=2000).collect()} == left


def test_multi_index_finds_everything_within_the_radius():
    draw = np.random.default_rng(4)
    a = draw.integers(0, 2**63, (300, decontaminate.BLOCKS), dtype=np.uint64)
    for radius in (3, 21, decontaminate.radius_for(0.6)):
        b = a.copy()
        for row in b:
            for bit in draw.choice(64 * decontaminate.BLOCKS, radius, replace=False):
                row[bit // 64] ^= np.uint64(1 << int(bit) % 64)
        looked, near = decontaminate.within(a, b, radius)
        assert looked.all() and near.all()
        assert not decontaminate.within(a, np.roll(b, 1, axis=0), radius)[1].any()


def test_multi_index_prunes(small):
    radius = decontaminate.radius_for(0.6)
    items = decontaminate.Items(list(range(400)), pa.array([" ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=40)) for k in range(400)]), 0.6, 3, radius)
    a, b = items.fingerprints[:200], items.fingerprints[200:]
    looked, near = decontaminate.within(a[:, None], b[None, :], radius)
    assert looked.mean() < 0.05 and not near.any()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want)) and want


def test_every_operator_is_registered():
    names = set(queries.QUERIES)
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names and set(queries.ORACLE) <= names

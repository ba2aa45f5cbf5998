"""Fill-in-middle, PartEnum and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filingspark.llm import fim, lexical, line_dedup, near_texts, partenum

LAYOUT = fim.Layout()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
schema = "doc_id long, text string"


# ---- fill-in-middle


def formed(doc_id, text):
    """By slices of the list of units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or doc_id is None or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_slices_and_restores(spark):
    r = random.Random(2)
    bits = ["word", "Été", "語", "\U0001f600", " ", "\n", "<", ">", "P", "<P", "<S>", "1", "\x00", "é", "<M", ">"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", None, "x", "<M>", "ab " * 400_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (3, "another text"), (3, texts[3])], schema)
    df = df.select("*", F.lit(1).alias("output"), F.lit("x").alias("form"), F.lit(2).alias("n"))
    got = fim.restored(fim.fill_in_middle(df)).collect()
    want = [(i, *formed(i, t or "")) for i, t in enumerate(texts)] + [(None, *formed(None, "no id here")), (3, *formed(3, "another text")), (3, *formed(3, texts[3]))]
    assert sorted(map(repr, (tuple(x)[:6] for x in got))) == sorted(map(repr, want))
    assert Counter(x.restored for x in got) == Counter([*(t or "" for t in texts), "no id here", "another text", texts[3]])
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(df.limit(0))).count() == 0


@given(st.text(max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
@settings(max_examples=300, deadline=None)
def test_rotations_are_undone(text, a, b, form):
    data = text.encode("utf-8", "ignore")
    if any(m in data for m in LAYOUT.sentinels):
        return
    first, second = sorted((min(a, len(data)), min(b, len(data))))
    out = bytes(fim.arrange(data, first, second, form, LAYOUT.sentinels))
    p, m, s = data[:first], data[first:second], data[second:]
    assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
    assert fim.restore(out, form, LAYOUT.sentinels) == data


# ---- PartEnum


def shingle_set(text, width=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([60, 80, 85, 90]))
@settings(max_examples=400, deadline=None)
def test_similar_sets_share_a_signature(common, mine, yours, seed, percent):
    """Equal sets are one class and need none."""
    r = np.random.default_rng(seed)
    e = np.unique(r.integers(0, 1 << 63, common + mine + yours, dtype="u8"))
    r.shuffle(e)
    a, b = np.sort(e[: common + mine]), np.sort(np.concatenate([e[:common], e[common + mine :]]))
    inter = len(np.intersect1d(a, b))
    if 100 * inter >= percent * (len(a) + len(b) - inter) and len(a) + len(b) != 2 * inter:
        assert len(np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)))


def test_sets_that_fall_into_few_cells_still_share_one():
    """All elements in one part: most projections are empty, so the sets keep these signatures too."""
    s = partenum.scheme(4)
    e = np.arange(1, 200_000, dtype="u8")
    part = partenum._mixed(e) >> np.uint64(32)
    same = e[(part * np.uint64(s.n1) >> np.uint64(32)) == 0][:25]
    assert len(np.intersect1d(partenum.signatures(same, 85), partenum.signatures(same[:-2], 85)))


def test_bands_touch_only_their_neighbours():
    for percent in (60, 85):
        every = partenum.bands(percent)
        place = {n: i for i, (low, high) in enumerate(every[:40]) for n in range(low, min(high, 3000) + 1)}
        for n in range(1, 2500):
            assert place[n] - place[-(-percent * n // 100)] <= 1


def components(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_components_equal_brute_force(spark, broadcast_rows):
    r = random.Random(4)
    words = [f"{c}{v}" for c in "bcdfgh" for v in "aeiou"] + ["É", "<P>", "语"]
    base = [[r.choice(words) for _ in range(r.choice([3, 4, 9, 12, 20, 60, 150, 400]))] for _ in range(14)]
    vary = lambda w, p: [x if r.random() > p else r.choice(words) for x in w]
    texts = [" ".join(vary(r.choice(base), r.choice([0, 0.002, 0.01, 0.02, 0.04]))) for _ in range(150)]
    star = [f"s{i}" for i in range(120)]  # copies of one text that are similar to it and not to each other
    texts += [" ".join(star), *(" ".join([*star[: 8 * k + 3], "x", *star[8 * k + 4 :]]) for k in range(12))]
    texts += [texts[0].upper(), texts[1].replace(" ", "\n\t"), "", None, " \v\f", "A b c", "a B\nc", "a b c d", "x" * 500_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (None, texts[0]), (7, texts[7])], schema).select("*", F.lit(1).alias("node"), F.lit(2).alias("n"), F.lit(3).alias("sig"))
    got = partenum.similar_components(df, broadcast_rows=broadcast_rows).collect()
    want = components(rows)
    assert len(got) == len(rows) + 2
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == {(i, n, c) for i, (n, c) in want.items()}
    assert [x.component_id for x in got if x.doc_id is None] == [None]
    assert sum(i != c for i, (_, c) in want.items()) > 60


def test_different_texts_of_one_doc_id_link_apart(spark):
    long_ = lambda s: " ".join(f"{s}{i}" for i in range(40))
    df = spark.createDataFrame([(5, long_("a")), (5, long_("b")), (6, long_("b") + " more"), (9, long_("a") + " else")], schema)
    got = sorted((x.doc_id, x.component_id) for x in partenum.similar_components(df).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (9, 5)]
    assert partenum.similar_components(df.limit(0)).count() == 0


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top):
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(x for _, c in counts for x in c)
    out = []
    for key, text in items:
        scores = []
        for i, c in counts:
            if i is None:
                continue
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(TERM.findall(lower(text))) if x in c)
            if s > 0:
                scores.append((-s, i))
        out += [(key, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_search_equals_brute_force(spark, broadcast_rows):
    r = random.Random(6)
    words = [f"{c}{v}" for c in "bcdfghklm" for v in "aeiou"] + ["É", "été", "语", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(r.choices(words, weights, k=n)).replace("ba ", "Ba, ")
    docs = [(i, text(r.choice([1, 2, 5, 30, 200, 900]))) for i in range(300)]
    docs += [(300, "ba " * 5000), (301, "ba"), (302, "ba"), (303, ""), (304, None), (305, "!?"), (5, docs[5][1]), (5, "other ba be"), (None, "ba bi bo"), (400, "rare " * 40)]
    items = [(0, "ba be bi"), (1, text(60)), (2, "rare word ba"), (3, "nothing knows this"), (4, ""), (5, None), (6, "été 语 É X9"), (7, "ba ba ba"), (8, text(20)), (8, "ba")]
    d = spark.createDataFrame(docs, schema).select("*", F.lit(1).alias("score"), F.lit(1).alias("item"), F.lit(1).alias("tag")).repartition(3)
    q = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("rank", F.lit(1))
    got = lexical.search(d, q, 12, broadcast_rows)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == ranked(docs, items, 12)
    assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == 0


def test_bounds_are_never_below_a_score(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 10, 300])))) for i in range(60)] + [(60, "w1 " * 9000 + "w2")]
    df = spark.createDataFrame(docs, schema)
    items = next(lexical.Items.blocks(spark.createDataFrame([(0, "w1 w2 w3 none"), (1, "w5")], "item_id long, text string")))
    blocks = lexical.build_index(df.coalesce(1)).collect()
    n, total = sum(b.n_docs for b in blocks), sum(b.n_terms for b in blocks)
    assert (n, total) == (61, sum(len(t.split()) for _, t in docs))
    for b in blocks:
        bounds = lexical._bounds(b.asDict(), items, [7, 11, 13, 17, 19], n, total)
        for d, (doc, length) in enumerate(zip(np.frombuffer(b.ids, "i8"), np.frombuffer(b.lengths, "i8"))):
            c = Counter(lexical.terms_of(dict(docs)[doc]))
            for i, places in enumerate(items.places):
                score = sum([7, 11, 13, 17, 19][p] * lexical.term_score(c[items.terms[p]], lexical.length_factor(int(length), n, total)) for p in places if items.terms[p] in c)
                assert bounds[i, d] >= score


# ---- texts of one doc_id


def test_texts_that_share_a_doc_id_keep_their_own_fate(spark):
    """Whatever hashes two texts of a doc_id have, only the copy goes, and only its lines."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    df = spark.createDataFrame([(0, a), (1, a), (1, b), (1, "c d e"), (2, b)], schema).select("*", F.lit(9).alias("part"), F.lit(8).alias("h1"), F.lit(7).alias("doc"))
    kept = near_texts.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.part, r.h1, r.doc) for r in kept.collect()) == sorted([(0, a, 9, 8, 7), (1, b, 9, 8, 7), (1, "c d e", 9, 8, 7)])
    lines = line_dedup.dedup_lines(df)
    assert lines.columns == df.columns
    assert sorted((r.doc_id, r.text, r.part) for r in lines.collect()) == sorted([(0, a, 9), (1, "", 9), (1, b, 9), (1, "c d e", 9), (2, "", 9)])


def test_many_texts_of_one_doc_id(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(8)) for i in range(1500)]
    df = spark.createDataFrame([(1, t) for t in texts] + [(0, texts[7])], schema)
    assert sorted(r.text for r in line_dedup.dedup_lines(df).collect()) == sorted(["", texts[7], *(t for i, t in enumerate(texts) if i != 7)])


# ---- the query of audio fingerprints, and loose personal data


def test_audio_query_aligns_shifted_and_noisy_recordings(spark):
    from filingspark.llm import audio, registry

    sf = "/root/testdata/sf0.001"
    rows = registry.op9_chroma_audio(spark, sf).collect()
    table = {r.vec_id: list(r.embedding or []) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    codes = {(v, k): audio.fingerprint(registry.recording({"vec_id": v, "embedding": e, "variant": k})).tolist() for v, e in table.items() for k in range(registry.VARIANTS)}
    assert {(r.vec_id, r.variant) for r in rows} == set(codes)
    # brute force: a copy is found if its query stands in one of its rows, a shifted one at the right offset
    asked = [v for v in table if v % 50 == 0 and len(codes[v, 0]) > 10]
    first = {tuple(codes[v, 0]): v for v in sorted(asked, reverse=True)}
    found = {(r.vec_id, r.variant, r.query_id): r for r in rows if r.query_id is not None}
    hits = [found.get((v, k, first[tuple(codes[v, 0])])) for v in asked for k in (1, 2)]
    assert asked and sum(h is not None for h in hits) >= 0.9 * len(hits)
    moved = [h for h in hits if h is not None and h.variant == 1]
    assert sum(h.offset == -3 and h.bit_error == 0 for h in moved) >= 0.9 * len(moved)
    assert all(h.bit_error < 0.2 for h in hits if h is not None and h.variant == 2)


def test_planted_loose_spans_are_found_and_look_alikes_are_not(spark):
    """A form that mostly stands in base spans is found without their prefix as well."""
    from filingspark.llm import pii

    r = random.Random(9)
    words = "the river runs past old towns and small farms toward a wide sea of grass".split()
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(4, 12)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    strict = [lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: f"+1 {number(3)}-{number(3)}-{number(4)}"]
    loose = [lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}"]
    decoys = [lambda: f"20{number(2)}-0{r.randint(1, 9)}-1{number(1)}", lambda: f"v{number(1)}.{number(2)}.{number(1)}", lambda: f"order {number(6)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(3)} of {number(4)}"]
    rows, planted, clean = [], {}, {}
    for i in range(1200):
        kind = "loose" if i % 25 == 0 else "decoy" if i % 3 == 0 else "strict"
        span = r.choice({"strict": strict, "loose": loose, "decoy": decoys}[kind])()
        head = prose() + " call "
        rows.append((i, f"{head}{span} {prose()}"))
        (planted if kind == "loose" else clean if kind == "decoy" else {})[i] = (len(head), len(head) + len(span))
    got = {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame(rows, schema)).collect()}
    assert sum(f"phone:{a}:{z}" in got[i] for i, (a, z) in planted.items()) >= 0.9 * len(planted)
    assert sum(got[i] == "" for i in clean) >= 0.98 * len(clean)


# ---- very long texts and clashing columns of the operators that pass texts through workers


def test_very_long_texts_pass_every_worker(spark):
    from filingspark.llm import chat, chunk_bpe, quality, simhash, token_counts
    from filingspark.llm.registry import vocabulary
    from tokenizers import Tokenizer

    long_ = " ".join(f"word{i % 977} and" for i in range(60_000))
    df = spark.createDataFrame([(1, long_), (2, long_ + " end"), (3, "short")], schema)
    word = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    coded = {r.doc_id: r for r in chunk_bpe.encode_decode(df, vocabulary("word_bpe_49k.json")).collect()}
    ids = word.encode(long_, add_special_tokens=False).ids
    assert coded[1].n_tokens == len(ids) and np.frombuffer(coded[1].ids, "<u4").tolist() == ids
    byte = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_prefix_counts(df, vocabulary("byte_bpe_50k.json")).collect()}[2] == len(byte.encode(long_ + " end", add_special_tokens=False).ids)
    fp = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert fp[2] == 1 and fp[3] == 3
    assert [r.doc_id for r in near_texts.drop_copies(df).orderBy("doc_id").collect()] == [1, 3]
    turns = spark.createDataFrame([(1, 0, "user", long_), (1, 1, "assistant", long_)], "conv_id long, turn long, role string, text string")
    told = chat.digests(chat.format_conversations(turns)).first()
    assert (told.n_turns, told.loss_chars, told.loss_sha256) == (2, len(long_), hashlib.sha256(long_.encode()).hexdigest())
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.classify(df, labels, F.lit("s"), F.lit("l")).count() == 3


def test_clashing_columns_change_nothing(spark):
    from filingspark.llm import audio, chat, chunk_bpe, packing, token_counts
    from filingspark.llm.registry import vocabulary

    texts = spark.createDataFrame([(i, f"some words and number {i}") for i in range(20)], schema)
    odd = texts.select("*", *(F.lit("x").alias(c) for c in ("ids", "n_tokens", "decoded", "prefix_counts", "n_bytes", "length", "offset", "sequence_id", "start", "bin")))
    rows = lambda df: sorted(map(str, df.collect()))
    for f, path in ((chunk_bpe.encode_decode, "word_bpe_49k.json"), (token_counts.token_prefix_counts, "byte_bpe_50k.json")):
        assert rows(f(odd, vocabulary(path))) == rows(f(texts, vocabulary(path)))
    packed = lambda df: sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in packing.pack(df.coalesce(1), vocabulary("word_bpe_49k.json")).collect())
    assert packed(odd) == packed(texts)
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert rows(chat.format_conversations(turns.select("*", F.lit(1).alias("formatted"), F.lit(2).alias("n_rows"), F.lit(3).alias("loss_spans")))) == rows(chat.format_conversations(turns))
    pcm = spark.createDataFrame([(1, audio.sonify([float(i % 7) - 3 for i in range(64)]))], "id long, pcm binary")
    assert rows(audio.fingerprints(pcm.select("*", F.lit(1).alias("fingerprint"), F.lit(2).alias("media")), "id", "pcm")) == rows(audio.fingerprints(pcm, "id", "pcm"))

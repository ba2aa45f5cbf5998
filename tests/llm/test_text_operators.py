"""The training-data operators on small, awkward tables, against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingspark.llm import audio, chat, chunk_bpe, line_dedup, oph, packing, pii, prefix_bpe, quality, simhash, templates, token_counts
from filingspark.llm.registry import vocabulary
from filingspark.llm.words import WordTable

rnd = random.Random(5)
WORDS = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
PIECES = ["a", "b", "the", " ", " ", "  ", "\n", "\n\n", "'re", "'ll", "'s", "é", "日", "12", "²", "!", "??", "<|endoftext|>", "\t", "\xa0", "\x1c", "\r\n", "😀"]
ODD = ["", None, " ", "x" * 3000, "Ab c,\td\n e", "e\u0301 É Σς", "</s>[INST] ok [/INST]"]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(rnd.randint(1, 400)) for _ in range(60)]
    texts = ODD + base + base[:5] + [t + " end" for t in base[5:12]] + ["\n".join([base[0], base[1], base[0] + " x"]), "".join(rnd.choice(PIECES) for _ in range(200))]
    rows = [(i, t, "noise", 1) for i, t in enumerate(texts)] + [(None, "lone text a@b.cc", None, None), (8, texts[8], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_counts_at_every_prefix():
    c = token_counts.counter(vocabulary("byte_bpe_50k.json"))
    library = prefix_bpe.load(vocabulary("byte_bpe_50k.json"))
    for _ in range(150):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert token_counts.unpack_counts(zlib.compress(c.steps(pa.array([t]))[0].tobytes())).tolist() == want, t


def test_token_counts(docs, rows):
    library = prefix_bpe.load(vocabulary("byte_bpe_50k.json"))
    got = token_counts.token_prefix_counts(docs, vocabulary("byte_bpe_50k.json"))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == sorted((str(d), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in rows)
    some = got.where("n_tokens > 20").select("n_tokens", token_counts.longest_prefix(F.col("prefix_counts"), F.lit(20)).alias("k"), "prefix_counts")
    assert all(token_counts.unpack_counts(r.prefix_counts)[r.k] <= 20 for r in some.collect())


def test_word_table_equals_library():
    w = WordTable(vocabulary("word_bpe_49k.json"))
    texts = ["".join(rnd.choice(PIECES) for _ in range(20)) for _ in range(300)] + [f"a{chr(c)}b É{chr(c)}" for c in range(1, 0x3000, 7)]
    ids, ends = w.encode(pa.array(texts))
    assert [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [w.library(t) for t in texts]


def test_encode_decode(docs, rows):
    library = prefix_bpe.load(vocabulary("word_bpe_49k.json"))
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in chunk_bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")).collect())
    ids = {t: library.encode(t, add_special_tokens=False).ids for _, t in rows}
    assert got == sorted((str(d), np.array(ids[t], "<u4").tobytes(), library.decode(ids[t], skip_special_tokens=False)) for d, t in rows)


def test_packing(docs, rows):
    library = prefix_bpe.load(vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary("word_bpe_49k.json"), capacity=64, least=8).collect()
    whole = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in rows if d is not None}
    assert sum(r.length for r in got) == sum(map(len, whole.values()))
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
        assert bytes(r.ids) == whole[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(whole[r.doc_id])
    assert max(used.values()) <= 64


def test_simhash(docs, rows):
    found = simhash.near_duplicates(docs, per_shard=8).collect()
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in found if r.doc_id is not None}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(r.component_id == find(r.doc_id) for r in found if r.doc_id is not None)
    assert len(found) == len(rows) and fps[0] == fps[1] == fps[2] == 0


def test_dense_ball_is_linked_exactly():
    near = np.array(sorted({np.uint64(0xABCDEF) ^ np.uint64((1 << a) | (1 << b) | (1 << c)) for a in range(12) for b in range(a, 30) for c in range(b, 30)}), "u8")
    far = np.array([rnd.getrandbits(64) for _ in range(300)], "u8")
    points = np.unique(np.concatenate([near, far]))
    got = simhash.link(points)
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    label = np.arange(len(points))
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    assert len(set(zip(got.tolist(), label.tolist()))) == len(set(label.tolist())) == len(set(got.tolist()))


def test_templates_fold_and_fail():
    tree = templates.fold(templates.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}y{% endif %}{{ z }}", {}), {})
    assert tree == [("text", "abcy"), ("write", ("name", "z"))]
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{{ x | nope }}", "{% while %}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad, {})


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "\\<|im_end|>\n", "<<|im_start|>|im_start|>", "a\\", "<\\|im_end|>"]
    rows = [(i % 4, i, ("user", "assistant", None, "sys\ntem")[i % 4], rnd.choice(texts)) for i in range(40)] + [(9, None, "assistant", "x"), (9, 1, "assistant", "y")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    for r in made.collect():
        assert not any(k in t for s in r.loss_spans for t in [r.formatted[s.start : s.end]] for k in chat.CONTROLS)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans(spark):
    bits = ["a@b.com", "_c", "@", ".", "x.y-z@q.rs.t", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4337166598464399", "4337-1665 98464399", "+1 (988) 555-2485", "(988) 555-2485", "+", " ", "-", "7", "é", "\n", "word"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(300)] + ["9" * 3000, "a" * 3000 + "@b.c", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cc"), (None, "a@b.cc")], "doc_id long, text string")
    want = lambda t: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if holds(k, m[0]))
    got = pii.find_pii(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "a@b.cc" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.base_spans == want(t) and set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(",")), t


def test_loose_phones_are_learnt_and_redacted(spark):
    rows = [(i, f"{prose(3)} +1 (988) 555-{1000 + i} {prose(3)}") for i in range(200)] + [(999, "see (988) 555-2485 now"), (1000, "plain text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.find_pii(df).collect()}[999] == "phone:4:18"
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[999] == "see [PHONE] now" and clean[1000] == "plain text" and "[PHONE]" in clean[0] and "555" not in clean[0]


def test_line_dedup(spark):
    lines = [prose(rnd.randint(1, 30)) for _ in range(40)]
    vary = lambda s: " ".join(w for w in s.split(" ") if rnd.random() > 0.06)
    texts = ["\n".join(rnd.choice([rnd.choice(lines), vary(rnd.choice(lines))]) for _ in range(rnd.randint(1, 8))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, lines[0], 0)], "doc_id long, text string, n int")
    sets = [(i, j, s) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n")) if (s := set(x.lower().split()))]
    want = {(i, j) for k, (i, j, s) in enumerate(sets) if any(len(s & o) / len(s | o) >= 0.8 for _, _, o in sets[:k])}
    assert {(r.doc_id, r.line_no) for r in line_dedup.later_matches(df, broadcast_rows=0).collect()} == want
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert all(clean[i] == (t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in want)) for i, t in enumerate(texts)) and clean[None] == lines[0]


def test_line_report_leaves_texts_where_they_are(spark):
    """Only line counts go by doc_id, not the texts; and levels of frequency are those of a plain count."""
    texts = ["a b c d e\nf g", "a b c d e", None, "f g a\n\na"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = line_dedup.line_report(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "split(" not in top
    assert [(r.doc_id, r.n_lines, r.n_removed) for r in out.orderBy("doc_id").collect()] == [(0, 2, 0), (1, 1, 1), (2, 0, 0), (3, 3, 0)]
    words = [w for t in texts if t for w in t.replace("\n", " ").split(" ")]
    ids = [r.i for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr(f"xxhash64(w) & {(1 << 18) - 1} as i").collect()]
    want = bytearray(1 << 18)
    for i in set(ids):
        want[i] = int(2 * math.log2(ids.count(i)))
    assert line_dedup.rarity(df) == bytes(want)


def test_fingerprints(docs, rows):
    got = oph.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    known = dict(sorted((d, t) for d, t in rows if d is not None))
    ids = list(known)
    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) if (w := re.split("[ \t-\r]+", t.strip(" \t\n\x0b\x0c\r"))) != [""] else set()
    prints = {}
    for r in got:
        if r.doc_id is None:
            continue
        t, following = known[r.doc_id], known[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        k = len(t) // 4
        assert r.edited == t[: len(t) - k] + following[:k] and r.n_chars == len(t)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = shingles(t), shingles(r.edited)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        c = shingles(following)
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.25
    again = oph.fingerprints(docs.sparkSession.createDataFrame([(r.doc_id, r.edited) for r in got], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.fingerprint) for r in again] == [(r.doc_id, r.edited_fingerprint) for r in got]


def test_quality_keeps_good_and_drops_junk(spark):
    good = [(i, f"{prose(80).capitalize()}.", "h", "p") for i in range(150)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!!" for w in prose(10).split()) * 6, "h" if i % 2 else None, "q") for i in range(40)] + [(5000, None, None, None)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in (good + junk)[::2]], "doc_id long, quality int")
    keep = {r.doc.doc_id: r.quality.keep for r in quality.classify(df, labels, F.col("source"), F.col("lang")).collect()}
    assert len(keep) == len(good) + len(junk)
    assert sum(keep[r[0]] for r in good) >= 148 and sum(keep[r[0]] for r in junk[:-1]) <= 1
    assert quality.classify(df, labels.limit(0), F.col("source"), F.col("lang")).where("quality.keep").count() == len(keep)


def test_audio_finds_shifted_and_noisy_recordings(spark):
    tune = [rnd.gauss(0, 1) for _ in range(64)]
    pcm = np.frombuffer(audio.sonify(tune), "<i2")
    noisy = (pcm + np.random.default_rng(1).normal(0, 60, len(pcm))).astype("<i2")
    rows = [(50, pcm.tobytes()), (1, noisy.tobytes()), (2, pcm[8 * audio.HOP :].tobytes()), (3, audio.sonify([rnd.gauss(0, 1) for _ in range(64)])), (4, None), (5, b""), (6, pcm.tobytes())]
    prints = audio.fingerprints(spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in rows], "id long, pcm binary"), "id", "pcm")
    got = {r.id: r for r in audio.align(prints, F.col("id") % 50 == 0).collect()}
    assert len(got) == 7 and got[6].class_id == got[50].class_id == 6
    assert got[2].query_id == 50 and got[2].offset == -8 and got[2].bit_error == 0
    assert got[1].query_id == 50 and got[1].offset == 0 and got[1].bit_error < 0.1
    assert got[3].query_id is None and got[4].query_id is None and got[5].n_codes == 0


def test_audio_keeps_every_alignment(spark):
    r = np.random.default_rng(3)
    tunes = [np.frombuffer(audio.sonify(r.normal(0, 1, 64).tolist()), "<i2") for _ in range(3)]
    noisy = lambda x: (x + r.normal(0, 500, len(x))).astype("<i2")
    half = len(tunes[0]) // 2
    pcm = {50: tunes[0], 100: noisy(tunes[0]), 150: tunes[1], 1: noisy(tunes[0]), 2: np.concatenate([tunes[0][half:], tunes[1]]), 3: tunes[1], 4: tunes[2], 200: tunes[1][5 * audio.HOP :]}
    # a query that shares only the last three integers of a noisy copy, without a bit error
    codes = {i: audio.fingerprint(x.tobytes()).tolist() for i, x in pcm.items()}
    codes[250] = codes[1][-3:] + r.integers(0, 1 << 31, 40).tolist()
    df = spark.createDataFrame(list(codes.items()), "id long, fingerprint array<int>")
    first = {}
    for i in sorted(codes):
        if i % 50 == 0:
            first.setdefault(tuple(codes[i]), i)
    want = {}
    for q_codes, q in first.items():
        for i, c in codes.items():
            if tuple(c) != q_codes:
                votes = {o: sum(q_codes[k : k + 2] == tuple(c[k + o : k + o + 2]) for k in range(max(0, -o), min(len(q_codes), len(c) - o) - 1)) for o in range(-len(q_codes), len(c))}
                best = max(votes, key=lambda o: (votes[o], min(len(q_codes), len(c) - o) - max(0, -o), -o))
                if votes[best]:
                    want[i, q] = (best, votes[best])
    got = audio.align(df, F.col("id") % 50 == 0).collect()
    assert {(x.id, x.query_id): (x.offset, x.votes) for x in got if x.query_id is not None} == want
    assert {x.id for x in got} == set(codes) and len(got) == len(want) + len(set(codes) - {i for i, _ in want})
    assert {(100, 50), (50, 100), (2, 50), (2, 150), (1, 250)} <= set(want)
    assert {x.query_id for x in got if x.id == 1 and x.place == 1} <= {50, 100} and {x.class_id for x in got if x.id in (3, 150)} == {3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    path = vocabulary("word_bpe_49k.json")
    assert simhash.near_duplicates(none).count() == packing.pack(none, path).count() == chunk_bpe.encode_decode(none, path).count() == 0
    assert pii.find_pii(none).count() == line_dedup.dedup_lines(none).count() == oph.edited_likeness(none).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang")).count() == 0


def test_short_lines_and_all_white_space(spark):
    r = random.Random(11)
    texts = ["\n".join(r.choice([" ", "\t", "\xa0", "　", "  "]).join(r.choice("Ab ac d e f g h i".split()) for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 6))) for _ in range(60)]
    texts += ["All rights reserved.\n同じ行です", "x\nall RIGHTS reserved.\r\n\n同じ行です", "one\ttwo\tthree\tfour\tfive\tsix", "one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [(i, j, s) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n")) if (s := set(x.lower().split()))]
    want = {(i, j) for k, (i, j, s) in enumerate(sets) if any(len(s & o) / len(s | o) >= 0.8 for _, _, o in sets[:k])}
    assert {(61, 1), (61, 3), (63, 0)} <= want
    assert {(x.doc_id, x.line_no) for x in line_dedup.later_matches(df).collect()} == want


def test_near_texts_are_found_exactly(spark):
    from filingspark.llm import near_texts

    r = random.Random(12)
    base = [[r.choice(WORDS) for _ in range(r.randint(1, 150))] for _ in range(15)]
    vary = lambda w, p: [x if r.random() > p else r.choice(WORDS) for x in w]
    texts = [" ".join(vary(r.choice(base), r.choice([0, 0.005, 0.01, 0.02, 0.03]))) for _ in range(120)] + ["", " \n", None, "a b", "A\nb"]
    texts += ["\n".join(texts[0].split(" "))]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8
    want = {i for i, s in enumerate(sets) if any(alike(s, o) for o in sets[:i])}
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    assert {x.doc_id for x in near_texts.later_copies(df).collect()} == want
    found = {x.doc_id for x in simhash.near_duplicates(df).where("doc_id <> component_id").collect()}
    assert want - found
    import corpus_pipeline

    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, df, None).collect()} == {None, *range(len(texts))} - want


def test_written_out_addresses_need_no_other_sign(spark):
    spans = ["jane.doe (at) corp.com", "jane.doe [at] corp.com", "jane.doe at corp.com", "jane.doe(at)corp (dot) com", "jane.doe at corp dot com"]
    far = {i: f"write {s} soon" for i, s in enumerate(spans)} | {i + 10: f"write {s} soon, or @ 1 dot" for i, s in enumerate(spans)} | {30: "we met at home"}
    seen = pii.proposals(spark.createDataFrame(list(far.items()), "doc_id long, text string")).where("kind = 'email'")
    assert {(r.doc_id, r.start, r.end) for r in seen.collect()} == {(i + k, 6, 6 + len(s)) for i, s in enumerate(spans) for k in (0, 10)}


def test_successors_of_sparse_and_repeated_ids(spark):
    ids = [-5, 0, 3, 3, 10**15, 10**6, None]
    got = {r.doc_id: r.next_id for r in oph.successors(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").repartition(4)).collect()}
    known = sorted({i for i in ids if i is not None})
    assert got == dict(zip(known, known[1:] + known[:1]))


def test_simhash_fingerprint_is_the_stated_one(spark):
    from xxhash import xxh64_intdigest

    texts = [*ODD, "One two", "a b c", "a b c a b c a b c d", prose(200), "É\x0bb\x0cC\x1dd e"]

    def brute(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
        hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_sites_shrink_and_decide(spark):
    good, junk = [f"{prose(60).capitalize()}." for _ in range(120)], [" ".join(f"{w.upper()}!!" for w in prose(12).split()) * 5 for _ in range(120)]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    train = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    model = quality.train(train, labels)
    words = prose(60).split()
    mixed = [" ".join([w.upper() + "!!" if i < k else w for i, w in enumerate(words)]) for k in range(61)]
    scored = spark.createDataFrame(list(enumerate(mixed)), "k int, text string").select("k", quality.evidence(model, F.col("text")).alias("e")).collect()
    border = mixed[min(scored, key=lambda r: abs(r.e)).k]
    rows = [(i, t, "good", "p") for i, t in enumerate(good)] + [(120 + i, t, "bad", "q") for i, t in enumerate(junk)]
    rows += [(500, border, "good", "p"), (501, border, "bad", "q"), (502, border, "rare", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc.doc_id: r.quality for r in quality.classify(df, labels, F.col("source"), F.col("lang")).collect()}
    assert got[500].keep and not got[501].keep and got[500].evidence == got[501].evidence
    # brute force of the posteriors, from the evidence alone
    p = {}
    for r in got.values():
        p.setdefault((r.host, r.path), []).append(1 / (1 + np.exp(-r.evidence)))
    cells = {k: (len(v), sum(v)) for k, v in p.items()}
    n, s = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
    mean = s / n

    def strength(groups, centres):
        inside, ss = mean * (1 - mean), sum(k * (t / k - c) ** 2 for (k, t), c in zip(groups, centres))
        between = (ss - (len(groups) - 1) * inside) / max(n - sum(k * k for k, _ in groups) / n, 1e-9)
        return min(max(inside / between - 1, 1.0), 1e6) if between > 0 else 1e6

    a = strength(list(cells.values()), [mean] * len(cells))
    host = {k: (t + a * mean) / (m + a) for k, (m, t) in cells.items()}
    b = strength(list(cells.values()), [host[k] for k in cells])
    sites = quality.site_posteriors(spark.createDataFrame([(*k, float(x)) for k, v in p.items() for x in v], "host string, path string, p double")).collect()
    for r in sites:
        k = (r.host, r.path)
        assert r.host_posterior == pytest.approx(host[k]) and r.path_posterior == pytest.approx((cells[k][1] + b * host[k]) / (cells[k][0] + b))
    one = next(r for r in sites if r.host == "rare")
    assert abs(one.path_posterior - mean) < abs(cells["rare", "r"][1] - mean) + 1e-9 and abs(one.path_posterior - mean) < 0.1


def test_audio_recall_of_noisy_and_shifted_recordings(spark):
    r = np.random.default_rng(8)
    tunes = [np.frombuffer(audio.sonify(r.normal(0, 1, 64).tolist()), "<i2") for _ in range(12)]
    pcm = {50 * (i + 1): t for i, t in enumerate(tunes)}
    changed = {}
    for i, t in enumerate(tunes):
        for j, (shift, noise) in enumerate([(0, 200), (7, 0), (5, 300), (12, 600)]):
            part = t[shift * audio.HOP :]
            changed[50 * (i + 1) + j + 1] = (50 * (i + 1), -shift)
            pcm[50 * (i + 1) + j + 1] = (part + r.normal(0, noise, len(part))).astype("<i2") if noise else part
    codes = {i: np.array(audio.fingerprint(x.tobytes())).view("u4") for i, x in pcm.items()}

    def errors(a, b):
        """Bit error at each offset with at least eight places."""
        out = {}
        for o in range(-len(a) + 8, len(b) - 7):
            lo, hi = max(0, -o), min(len(a), len(b) - o)
            out[o] = np.bitwise_count(a[lo:hi] ^ b[lo + o : hi + o]).mean() / 32
        return out

    brute = {}
    for i in changed:
        found = {(q, o): e for q in codes if q % 50 == 0 for o, e in errors(codes[q], codes[i]).items()}
        brute[i] = min(found, key=found.get)
    assert brute == changed
    df = spark.createDataFrame([(i, c.view("i4").tolist()) for i, c in codes.items()], "id long, fingerprint array<int>")
    best = {x.id: (x.query_id, x.offset) for x in audio.align(df, F.col("id") % 50 == 0).where("place = 1").collect()}
    assert sum(best.get(i) == brute[i] for i in changed) >= 0.9 * len(changed)


def test_rows_of_one_id_are_told_apart(spark):
    from filingspark.llm import near_texts

    a, b = prose(40), prose(40)
    df = spark.createDataFrame([(1, a, 1), (2, a, 2), (2, b, 3), (3, b, 4), (3, b, 4), (4, None, 5), (None, a, 6)], "doc_id long, text string, __id int")
    kept = near_texts.drop_copies(df)
    assert kept.columns == df.columns and sorted(r["__id"] for r in kept.collect()) == [1, 3, 5, 6]
    twice = spark.createDataFrame([(9, b), (9, b)], "doc_id long, text string")
    assert near_texts.drop_copies(twice).count() == 1 and near_texts.drop_copies(twice.limit(0)).count() == 0
    lines = line_dedup.dedup_lines(df).orderBy("__id").collect()
    assert [r.text for r in lines] == [a, "", b, "", "", None, a]


def test_more_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert token_counts.token_prefix_counts(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert pii.redact(none).count() == line_dedup.line_report(none).count() == oph.fingerprints(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_conversations(turns).count() == 0
    prints = audio.fingerprints(spark.createDataFrame([], "id long, pcm binary"), "id", "pcm")
    assert prints.count() == audio.align(prints, F.col("id") % 50 == 0).count() == 0


def test_extra_columns_of_any_name_stay(spark):
    names = ["__id", "__removed", "__h", "h", "d", "tag", "place", "words", "removed", "n", "fp", "__host", "__path", "__evidence", "start", "end", "doc", "quality", "evidence", "host", "part", "h1"]
    text = f"{prose(12)}\n{prose(9)} a@b.com"
    rows = [(i, t, *[i] * len(names)) for i, t in enumerate([text, text, None, "", "call +1 (988) 555-2485"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    from filingspark.llm import near_texts

    for out in (line_dedup.dedup_lines(df), pii.redact(df), near_texts.drop_copies(df)):
        assert out.columns == df.columns and all(r[n] == r["doc_id"] for r in out.collect() for n in names)
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, quality int")
    kept = quality.classify(df, labels, F.lit("s"), F.lit("l")).select("doc.*")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if all(r[n] == r["doc_id"] for n in names)) == list(range(len(rows)))
    for out in (line_dedup.line_report(df), pii.find_pii(df), oph.edited_likeness(df), simhash.near_duplicates(df)):
        assert out.count() == len(rows)


def test_very_long_texts(spark):
    long_line, many = " ".join(str(i) for i in range(60_000)), "\n".join(f"line number {i} of many" for i in range(20_000))
    df = spark.createDataFrame([(1, long_line), (2, long_line + " end"), (3, many), (4, "1.2.3.4 " * 20_000)], "doc_id long, text string")
    report = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert report[2].n_removed == 1 and report[1].n_removed == 0 and report[3].n_lines == 20_000
    found = {r.doc_id: r.n_ip for r in pii.find_pii(df).collect()}
    assert found[4] == 20_000 and found[3] == 0
    assert {r.doc_id: r.near_next > 0.9 for r in oph.edited_likeness(df).collect()}[1]
    packed = packing.pack(df, vocabulary("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t for r in packed)


def test_packing_at_production_size(spark):
    df = spark.createDataFrame([(i, prose(rnd.randint(0, 900))) for i in range(300)], "doc_id long, text string").repartition(2)
    rows = packing.pack(df, vocabulary("word_bpe_49k.json")).collect()
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in ends.values())
    assert max(ends.values()) <= 4096 and padding < 0.05 * sum(ends.values())
    for s in ends:
        places = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0

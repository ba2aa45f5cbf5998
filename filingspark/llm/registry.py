"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audio, chat, chunk_bpe, fim, lexical, line_dedup, oph, packing, partenum, pii, quality, simhash, token_counts


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    scored = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    shown = [F.round(f"quality.{c}", 6).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "posterior")]
    return scored.select("doc.doc_id", "quality.host", "quality.path", *shown, "quality.keep")


def op2_pii(spark, sf_dir):
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    counted = token_counts.token_prefix_counts(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    fits = token_counts.longest_prefix(F.col("prefix_counts"), F.lit(1024)).alias("cut_at")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), fits)


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op6_chat_format(spark, sf_dir):
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(rows))


def op7_bpe_chunks(spark, sf_dir):
    coded = chunk_bpe.encode_decode(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_harmonic_packing(spark, sf_dir):
    packed = packing.pack(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: What each recording is made in: as it is, begun three frames later, and with noise.
VARIANTS, _LATER, _NOISE = 3, 3, 300


def recording(media: dict) -> bytes:
    """16-bit samples of a row (vec_id, embedding, variant). The noise is drawn by the number."""
    import numpy as np

    x = np.frombuffer(audio.sonify(media["embedding"]), "<i2")
    if media["variant"] == 1:
        x = x[_LATER * audio.HOP :]
    elif media["variant"] == 2:
        noise = np.random.default_rng(abs(media["vec_id"] or 0)).normal(0, _NOISE, len(x))
        x = np.clip(x + noise, -32768, 32767).astype("<i2")
    return x.tobytes()


def op9_chroma_audio(spark, sf_dir):
    """Recordings of all embeddings, each as it is, shifted and noisy; every 50th as it is is a query."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.explode(F.array(*map(F.lit, range(VARIANTS)))).alias("variant"))
    made = vectors.select((F.col("vec_id") * VARIANTS + F.col("variant")).alias("id"), F.struct("vec_id", "embedding", "variant").alias("media"))
    prints = audio.fingerprints(made, "id", "media", recording)
    found = audio.align(prints, F.col("id") % (50 * VARIANTS) == 0)
    digest = F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256).alias("fingerprint_sha256")
    of = lambda c: F.floor(F.col(c) / VARIANTS).cast("long")
    return found.select(of("id").alias("vec_id"), F.pmod(F.col("id"), F.lit(VARIANTS)).cast("int").alias("variant"), "n_codes", digest, "class_id", of("query_id").alias("query_id"), "offset", "votes", "bit_error", "place")


def op10_fingerprints(spark, sf_dir):
    found = oph.edited_likeness(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_fill_in_middle(spark, sf_dir):
    formed = fim.restored(fim.fill_in_middle(_read(spark, sf_dir, "documents")))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_partenum(spark, sf_dir):
    return partenum.similar_components(_read(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_quality, op2_pii, op3_line_dedup, op4_token_counts, op5_simhash, op6_chat_format, op7_bpe_chunks, op8_harmonic_packing, op9_chroma_audio, op10_fingerprints, op11_fill_in_middle, op12_partenum, op13_lexical_search, pipeline)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    """None: each operator hashes, trains, tokenizes or joins by similarity, which SQL can't express or not on whole tables. Brute-force versions are in tests/llm."""
    return {}

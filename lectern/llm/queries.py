"""Queries of the training-data operators, one opN_<name> each, and their SQL where it can say it."""

from __future__ import annotations

import importlib

import corpus_pipeline
from lectern.llm import (
    alignment,
    chat,
    decontaminate,
    exact_dedup,
    html_text,
    line_dedup,
    ngram_join,
    oracles,
    pieces,
    quality_classifier,
    quality_rules,
    token_store,
    toxicity,
    vector_codes,
)
from lectern.session import table


def tokenizer_path(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_token_store(spark, sf_dir):
    return token_store.encode_and_read_back(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.rate(docs, quality_classifier.train(docs, labels))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scores(docs, toxicity.train(docs, labels))


def op7_chat_format(spark, sf_dir):
    own = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.render(chats))


def op8_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, bench))


def op10_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.trusted_documents(labels))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_html_text": op8_html_text,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}
#: The others train, hash, parse or compare beyond what SQL can do on whole tables; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_ngram_join": oracles.NGRAM_JOIN,
    "op7_chat_format": oracles.CHAT_FORMAT,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op11_exact_dedup": oracles.EXACT_DEDUP,
    "op12_vector_codes": oracles.VECTOR_CODES,
}

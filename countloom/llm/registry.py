"""Queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from countloom.llm import compact_windows, crf_toxicity, ftrl_quality, license_rules, merge_replay, positional_index, quality_rules, simhash, template_html, tput_search, trie_bpe, unigram_trie, whitening


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_html(spark, sf_dir):
    return template_html.extract(table(spark, sf_dir, "pages"))


def op2_unigram_trie(spark, sf_dir):
    return unigram_trie.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_crf_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return crf_toxicity.score(docs, crf_toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_license_rules(spark, sf_dir):
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op5_ngram_ratio(spark, sf_dir):
    return quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_gray_index(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_compact_windows(spark, sf_dir):
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op8_trie_bpe(spark, sf_dir):
    return trie_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_positional_index(spark, sf_dir):
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=3)


def op10_ftrl_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ftrl_quality.score(docs, ftrl_quality.train(docs, table(spark, sf_dir, "labels")))


def op11_tput_search(spark, sf_dir):
    return tput_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merge_replay(spark, sf_dir):
    return merge_replay.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_svd_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_template_html,
        op2_unigram_trie,
        op3_crf_toxicity,
        op4_license_rules,
        op5_ngram_ratio,
        op6_simhash_gray_index,
        op7_compact_windows,
        op8_trie_bpe,
        op9_positional_index,
        op10_ftrl_quality,
        op11_tput_search,
        op12_merge_replay,
        op13_svd_whitening,
    )
}
ORACLE: dict[str, str] = {"op4_license_rules": license_rules.oracle_sql(), "op9_positional_index": positional_index.oracle_sql(), "op11_tput_search": tput_search.oracle_sql()}

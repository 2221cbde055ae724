"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from lattica.llm import bpe_transducer, common, conversations, jpeg, language_model, maxscore, mixing, periodic, quality, simhash, suffix_dedup, token_counts, token_file, url_filter


def _shipped(f):
    return lambda spark, sf_dir: f(common.ship(spark), sf_dir)


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        simhash.op1_simhash,
        token_counts.op2_token_counts,
        suffix_dedup.op3_suffix_dedup,
        url_filter.op4_url_filter,
        quality.op5_quality_rules,
        language_model.op6_lm_scoring,
        token_file.op7_token_file,
        mixing.op8_mix_sources,
        bpe_transducer.op9_bpe,
        jpeg.op10_media,
        maxscore.op11_top_k,
        periodic.op12_periodic_runs,
        conversations.op13_repair,
    )
}
ORACLE_SQL = {"op4_url_filter": url_filter.OP4_SQL, "op8_mix_sources": mixing.OP8_SQL, "op11_top_k": maxscore.OP11_SQL, "op13_repair": conversations.OP13_SQL}

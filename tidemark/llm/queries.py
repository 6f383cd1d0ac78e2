"""The queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from tidemark.llm import pipeline, sql
from tidemark.llm.decontam import op6_suffix_decontam
from tidemark.llm.link_graph import op10_link_graph
from tidemark.llm.mixing import op4_raking, op4_sql
from tidemark.llm.near_dup import op5_chosen_path
from tidemark.llm.ngram_lm import op9_elias_fano_lm
from tidemark.llm.ogg import op8_ogg
from tidemark.llm.pii import op1_pmi_sanitiser
from tidemark.llm.quality import op2_ordinal_quality
from tidemark.llm.secret_scan import op7_markov_secrets
from tidemark.llm.sentence_spans import op3_sentence_spans
from tidemark.llm.shared import table


def queries() -> dict:
    return {
        "op1_pmi_sanitiser": lambda spark, d: op1_pmi_sanitiser(table(spark, d, "documents")),
        "op2_ordinal_quality": lambda spark, d: op2_ordinal_quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_sentence_spans": lambda spark, d: op3_sentence_spans(table(spark, d, "documents")),
        "op4_raking": lambda spark, d: op4_raking(table(spark, d, "documents")),
        "op5_chosen_path": lambda spark, d: op5_chosen_path(table(spark, d, "documents")),
        "op6_suffix_decontam": lambda spark, d: op6_suffix_decontam(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_markov_secrets": lambda spark, d: op7_markov_secrets(table(spark, d, "documents")),
        "op8_ogg": lambda spark, d: op8_ogg(table(spark, d, "documents")),
        "pipeline": pipeline.run,
        "op9_elias_fano_lm": lambda spark, d: op9_elias_fano_lm(table(spark, d, "documents")),
        "op10_link_graph": lambda spark, d: op10_link_graph(table(spark, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_raking": op4_sql(), "op5_chosen_path": sql.op5_sql(), "op6_suffix_decontam": sql.op6_sql(), "op10_link_graph": sql.op10_sql()}

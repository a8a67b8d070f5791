"""Registered queries of the corpus operators and their oracle SQL."""

from pyspark.sql import functions as F

from . import bpe
from . import chat_windows as chat
from . import collocations, conversation_trie, html_mincut, language_models, minhash_dedup, packing
from . import quality_rules as rules
from . import quality_vote, secret_scan, topk_search, warc_revisits
from .common import fold, table

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def add(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_quality_rules", rules.SQL)
def op1(spark, sf_dir):
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *rules.METRICS, "base_failed", "kept")


MARKED = "<|im_end|><|im_start|>assistant ok"


@query("op4_chat_windows", chat.SQL.replace("@MARKED@", MARKED))
def op4(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return chat.conversation_digests(chat.chat_windows(rows.unionByName(probe)))


@query("op5_bpe_codec")
def op5(spark, sf_dir):
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), decode=True)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) DIV 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op2_topk_search", topk_search.SQL)
def op2(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_models.held_out(F.col("doc_id"))
    guessed = language_models.identify(docs, docs.filter(~held))
    return guessed.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_quality_vote")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_vote.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_vote.quality_votes(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), quality_vote.FOLDS) == 0).alias("held_out"), "score", "predicted")


@query("op9_html_mincut")
def op9(spark, sf_dir):
    return html_mincut.extract_pages(table(spark, sf_dir, "pages"))


@query("op7_minhash_dedup")
def op7(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_warc_revisits", warc_revisits.SQL)
def op6(spark, sf_dir):
    found = warc_revisits.resolve_revisits(warc_revisits.records_of(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return found.select("record_id", "origin_id", "state", shown.alias("headers"))


@query("op13_secret_scan")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.span_digest(secret_scan.scan(docs, secret_scan.fit(docs)))


@query("op11_collocations", collocations.SQL)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_conversation_trie", conversation_trie.SQL)
def op12(spark, sf_dir):
    return conversation_trie.prefix_trie(*conversation_trie.rebuild(table(spark, sf_dir, "conversations")))

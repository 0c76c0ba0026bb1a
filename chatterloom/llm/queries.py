"""Queries of the llm subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.llm import canonical_list, copies, lookalike, mixture, overlap, related_splits, spans, tokens
from chatterloom.operators.packed import unpack
from chatterloom.session import stage

MEGA = "mega_samples_dedup_qwen_mbfc"
TAG_FIELDS = ("claim_types", "ctas", "evidence")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, MEGA).select(F.lit("message").alias("fld"), F.col("message_id").alias("id"), F.col("message").alias("text"))


def p1_found(spark, sf_dir):
    """Messages that look the same, and claim_types values that look like a label, in other characters."""
    labels = table(spark, sf_dir, "codebook_labels").where("tag_field = 'claim_types'").select(F.lit("label").alias("fld"), F.col("label_id").cast("bigint").alias("id"), F.col("label").alias("text"))
    typed = unpack(table(spark, sf_dir, MEGA), ["message_id"], ["claim_types"]).select("message_id", "tag_value")
    values = typed.groupBy(F.col("tag_value").alias("text")).agg(F.min("message_id").alias("id")).select(F.lit("value").alias("fld"), "id", "text")
    texts = stage(lookalike.canonical_texts(_messages(spark, sf_dir).unionByName(values).unionByName(labels), "fld", "id", "text"), "forms", by="fld")
    alike = lookalike.same_look_pairs(texts.where("fld = 'message'")).select(F.lit("message").alias("fld"), "id_a", "id_b")
    label = texts.where("fld = 'label'").select(F.col("id").alias("id_a"), F.col("raw").alias("raw_a"), "canon")
    value = texts.where("fld = 'value'").select("raw", "canon").join(label, "canon").where("raw_a <> raw").select("raw", "id_a").distinct()
    found = typed.withColumn("raw", F.unhex(F.md5("tag_value"))).join(value, "raw").select(F.lit("claim_types").alias("fld"), "id_a", F.col("message_id").alias("id_b")).distinct()
    return alike.unionByName(found)


def p1_links(spark, sf_dir):
    """Every message that looks like one in other characters, with its class and the number of such messages."""
    texts = lookalike.canonical_texts(_messages(spark, sf_dir), "fld", "id", "text")
    return lookalike.look_links(texts).withColumnRenamed("id", "message_id")


def p1_canonical(spark, sf_dir):
    """Every message in its canonical form; null messages stay null."""
    messages = _messages(spark, sf_dir)
    forms = lookalike.canonical_texts(messages, "fld", "id", "text", keep=True).select(F.col("id").alias("message_id"), F.col("canonical_text").alias("message"))
    empty = messages.where("text is null").select(F.col("id").alias("message_id"), F.col("text").alias("message"))
    return forms.unionByName(empty)


def _cross_split(spark, sf_dir):
    mega = table(spark, sf_dir, MEGA)
    return overlap.cross_split(mega, table(spark, sf_dir, "baseline_scores"), "message_id", "message", "split")


def p3_found(spark, sf_dir):
    """Messages of val or test that stand in train, the same or almost the same."""
    pairs = overlap.member_pairs(*_cross_split(spark, sf_dir))
    return pairs.select(F.least("id_train", "id_other").alias("id_a"), F.greatest("id_train", "id_other").alias("id_b")).distinct()


def p3_links(spark, sf_dir):
    """Every message of a split with the class of its words and the number of messages across the splits it is linked with."""
    return overlap.links(*_cross_split(spark, sf_dir)).withColumnRenamed("key", "message_id")


def p3_counts(spark, sf_dir):
    """Per split and domain: messages, those that stand in train, and pairs with train."""
    pairs = overlap.member_pairs(*_cross_split(spark, sf_dir)).distinct()
    hits = pairs.groupBy(F.col("id_other").alias("message_id"), "split").agg(F.count("*").alias("pairs"))
    rows = table(spark, sf_dir, "baseline_scores").where("split <> 'train'").select("message_id", "split").distinct()
    rows = rows.join(table(spark, sf_dir, MEGA).select("message_id", "normalized_domain"), "message_id").join(hits, ["message_id", "split"], "left")
    return rows.groupBy("split", "normalized_domain").agg(F.count("*").alias("n_messages"), F.count("pairs").alias("n_in_train"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))


CORE = "full_risk_v2_core"


def p5_found(spark, sf_dir):
    """Copies of core rows, each with the first row of its post."""
    return copies.copies(table(spark, sf_dir, CORE), "row_id", ["channel", "message"], required="message")


def p5_posts(spark, sf_dir):
    """One row per post with its number of copies."""
    return copies.posts(table(spark, sf_dir, CORE), "row_id", ["channel", "message"], required="message").select("kept_id", "n_copies")


def p4_found(spark, sf_dir):
    """The label each value means that is not a label as it stands, 0 for none."""
    values = unpack(table(spark, sf_dir, MEGA), ["message_id"], TAG_FIELDS)
    return canonical_list.map_to_list(values, table(spark, sf_dir, "codebook_labels"), ["message_id"])


def p4_unmatched(spark, sf_dir):
    """Every value that means no label of its field, with its number of occurrences."""
    return canonical_list.unmatched(unpack(table(spark, sf_dir, MEGA), ["message_id"], TAG_FIELDS), table(spark, sf_dir, "codebook_labels"))


def p4_fields(spark, sf_dir):
    """Per field: messages with a value that means no label of the field, and rows of p4_found."""
    return p4_found(spark, sf_dir).groupBy("tag_field").agg(F.count_if(F.col("label_id") == 0).alias("n_unmatched"), F.count("*").alias("n_mapped"))


def p7_splits(spark, sf_dir):
    """Every message with its split; no domain is in two."""
    return related_splits.assign(table(spark, sf_dir, MEGA), "message_id", ["normalized_domain"], "risk_label").select("message_id", "split")


def p7_totals(spark, sf_dir):
    """Rows of all splits, how far each is from its share, and domains that stand in two splits."""
    rows = p7_splits(spark, sf_dir).join(table(spark, sf_dir, MEGA).select("message_id", F.nullif("normalized_domain", F.lit("")).alias("d")), "message_id")
    n = rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")], F.count("*").alias("n_messages"), F.count_distinct("d").alias("n_domains"))
    in_splits = rows.where("d is not null").select("d", "split").distinct().agg(F.count("*").alias("n_in_splits"))
    off = [F.abs(F.col(s) - F.lit(share) * F.col("n_messages")) <= 1 for s, share in (("train", 0.7), ("val", 0.1), ("test", 0.2))]
    return n.crossJoin(F.broadcast(in_splits)).select("n_messages", "n_domains", "n_in_splits", *[o.alias(f"{s}_is_met") for o, s in zip(off, ("train", "val", "test"))])


def p7_components(spark, sf_dir):
    """Rows and domains of every component of messages that share a domain or stand in one place (channel and msg_id)."""
    mega = table(spark, sf_dir, MEGA).withColumn("place", F.concat("channel", F.lit("/"), "msg_id"))
    rows = related_splits.related(mega, "message_id", ["normalized_domain", "place"]).join(mega.select(F.col("message_id").alias("row"), "normalized_domain"), "row")
    return rows.groupBy(F.col("unit").alias("component")).agg(F.count("*").alias("n"), F.count_distinct(F.nullif("normalized_domain", F.lit(""))).alias("n_domains"))


def p7_balance(spark, sf_dir):
    """Rows, share of rows, domains and share of risk_label 1 per split."""
    rows = related_splits.assign(table(spark, sf_dir, MEGA), "message_id", ["normalized_domain"], "risk_label").join(table(spark, sf_dir, MEGA).select("message_id", "normalized_domain", "risk_label"), "message_id")
    out = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("normalized_domain").alias("n_domains"), F.round(F.avg("risk_label"), 6).alias("risk_share"))
    return out.select("split", "n", F.round(F.col("n") / F.sum("n").over(mixture._whole()), 6).alias("row_share"), "n_domains", "risk_share")


def p8_ids(spark, sf_dir):
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_round_trip(spark, sf_dir):
    """MD5 of every document's text as decoded from its ids; null texts come back empty."""
    return tokens.decode(p8_ids(spark, sf_dir), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def p8_lengths(spark, sf_dir):
    """Tokens of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text", count_only=True)


def _mix(spark, sf_dir, total=None):
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source").join(tokens.encode(docs, "doc_id", "text", count_only=True), "doc_id"), "sized")
    return mixture.mix(sized, table(spark, sf_dir, "source_mix"), "doc_id", "source", "n_tokens", total)


def p9_mix(spark, sf_dir):
    """Documents of the mix with their copies, at the largest size at which every source with documents has its share."""
    return _mix(spark, sf_dir)[0]


def p9_mix_full(spark, sf_dir):
    """Documents of the mix with their copies, at the size of one epoch of all listed sources: small sources are clamped, the others take up their excess."""
    return _mix(spark, sf_dir, "all")[0]


def p9_shares(spark, sf_dir):
    """Per source the share it should have and has, at that size."""
    return _mix(spark, sf_dir)[1]


def p9_shares_full(spark, sf_dir):
    """The same at the size of one epoch of all listed sources, where small sources reach their cap."""
    return _mix(spark, sf_dir, "all")[1]


def p10_found(spark, sf_dir):
    """Documents that share a run of at least 100 characters."""
    pairs = spans.document_pairs(*spans.shared(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return pairs.toDF("doc_id_a", "doc_id_b")


def p10_links(spark, sf_dir):
    """Every document of at least 100 characters with the class of its text and the number of documents it shares a run with."""
    return spans.links(*spans.shared(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p10_passages(spark, sf_dir):
    """Aligned passages, verbatim or changed by up to a fifth, of every two text classes (named by their first document)."""
    pairs, _ = spans.shared(table(spark, sf_dir, "documents"), "doc_id", "text")
    return spans.passages(pairs).withColumnsRenamed({"rep_a": "doc_id_a", "rep_b": "doc_id_b"})


def p10_stretches(spark, sf_dir):
    """The stretches of each document that also stand in another one."""
    return spans.stretches(*spans.shared(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p10_coverage(spark, sf_dir):
    """How much of each document's text also stands elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    s = spans.stretches(*spans.shared(table(spark, sf_dir, "documents"), "doc_id", "text")).groupBy(F.col("id").alias("doc_id")).agg(F.sum("length").alias("shared_chars"))
    shared_chars = F.coalesce("shared_chars", F.lit(0))
    return docs.join(s, "doc_id", "left").select("doc_id", "n_chars", shared_chars.alias("shared_chars"), F.round(shared_chars / F.nullif(F.col("n_chars"), F.lit(0)), 6).alias("shared_share"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_links, p1_canonical, p3_found, p3_links, p3_counts, p4_found, p4_unmatched, p4_fields, p5_found, p5_posts, p7_splits, p7_totals, p7_components, p7_balance,
        p8_ids, p8_round_trip, p8_lengths, p9_mix, p9_mix_full, p9_shares, p9_shares_full, p10_found, p10_links, p10_passages, p10_stretches, p10_coverage,
    )
}
_GRAMS = "g AS (SELECT doc_id, i, hash(substr(text, i, 100)) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS i FROM documents WHERE length(text) >= 100))"

ORACLE: dict[str, str] = {
    "p7_totals": f"""
        SELECT count(*) AS n_messages, count(DISTINCT nullif(normalized_domain, '')) AS n_domains, count(DISTINCT nullif(normalized_domain, '')) AS n_in_splits,
               true AS train_is_met, true AS val_is_met, true AS test_is_met FROM {MEGA}""",
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p10_found": f"""
        WITH {_GRAMS}, d AS (SELECT DISTINCT doc_id, gram FROM g), k AS (SELECT gram FROM d GROUP BY gram HAVING count(*) > 1), e AS (SELECT d.* FROM d JOIN k USING (gram))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM e a JOIN e b USING (gram) WHERE a.doc_id < b.doc_id""",
    "p10_coverage": f"""
        WITH {_GRAMS}, k AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1), s AS (SELECT doc_id, i FROM g JOIN k USING (gram)),
        c AS (SELECT doc_id, sum(w) AS shared_chars FROM (SELECT doc_id, least(100, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 100)) AS w FROM s) GROUP BY doc_id)
        SELECT doc_id, cast(length(text) AS bigint) AS n_chars, cast(coalesce(shared_chars, 0) AS bigint) AS shared_chars, round(coalesce(shared_chars, 0) / nullif(length(text), 0), 6) AS shared_share
        FROM documents LEFT JOIN c USING (doc_id)""",
}  # whole grams by 64-bit hash: enough for tables of this size

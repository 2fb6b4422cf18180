"""The registered queries: each applies an operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, context, detect, evaluate, export, feedback, learn, lexicon, refine
from ..sources import readers
from ..streaming import sessions
from . import fixtures

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark, d) -> DataFrame:
    return fixtures.planted(table(spark, d, "documents").select("doc_id", "text"))


def judged_of(spark, d) -> DataFrame:
    return candidates.judged(candidates.canonical(candidates.overlap_groups(detect.detections(docs_of(spark, d)))))


def _spans(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "line_no", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "text")


@query
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.concat(F.coalesce("text", F.lit("")), F.lit(" \t\r\nend\u0001\r"))).alias("cleaned"))


@query
def doc_metrics(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.line_count(t).alias("n_lines"), F.length(t).alias("n_code_points"))


@query
def english_gate(spark, d):
    t = F.coalesce("text", F.lit(""))
    n, share = T.stopword_share(t)
    return table(spark, d, "documents").select("doc_id", n.alias("n_words"), F.bround(share, 4).alias("share"), T.english_ratio(t).alias("ratio"), T.is_english(t).alias("english"))


@query
def short_non_prose(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_short_non_prose(F.coalesce("text", F.lit(""))).alias("short_non_prose"))


@query
def line_index(spark, d):
    return detect.lines(docs_of(spark, d)).select("doc_id", "line_no", F.length("line").alias("n_chars"))


@query
def normalize_names(spark, d):
    raw = F.concat(F.lit(" ("), F.col("c_name"), F.lit("  "), F.col("c_mktsegment"), F.lit("'s)., "))
    return table(spark, d, "customer").select("c_custkey", T.normalize_name(raw).alias("name"), T.strip_possessive(T.normalize_name(raw)).alias("stem"))


@query
def context_words(spark, d):
    rows = candidates.canonical(candidates.overlap_groups(detect.detections(docs_of(spark, d)))).join(detect.lines(docs_of(spark, d)), ["doc_id", "line_no"])
    return rows.select("doc_id", "line_no", F.col("start").alias("span_start"), T.preceding_word(F.substring("line", F.lit(1), F.col("start"))).alias("before"), T.following_char(F.substring("line", F.col("end") + 1, F.lit(500))).alias("after"), T.excerpt(F.col("line"), F.col("start"), F.col("end"), 20).alias("excerpt"))


@query
def bare_spans(spark, d):
    return _spans(detect.bare_spans(docs_of(spark, d)))


@query
def titled_spans(spark, d):
    return _spans(detect.titled_spans(docs_of(spark, d)))


@query
def dictionary_spans(spark, d):
    found = detect.dictionary_spans(docs_of(spark, d))
    return _spans(found).withColumn("pattern", F.when(F.col("text").contains(" "), "dictionary").otherwise("dictionary_single_token"))


@query
def overlap_merge(spark, d):
    g = candidates.overlap_groups(detect.detections(docs_of(spark, d)))
    return g.groupBy("doc_id", "line_no", "grp").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.count("*").alias("n"))


@query
def canonical_span(spark, d):
    c = candidates.canonical(candidates.overlap_groups(detect.detections(docs_of(spark, d))))
    return c.select("doc_id", "line_no", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "text", F.col("evidence").cast("double").alias("evidence"), F.concat_ws(",", "patterns").alias("patterns"))


@query
def stopword_trim(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit("The Of "), F.col("p_name"), F.lit(" and the")).alias("name"))
    return names.select("p_partkey", candidates.trim_stopwords(F.col("name")).alias("trimmed"))


@query
def repetition_counts(spark, d):
    return candidates.repetitions(candidates.canonical(candidates.overlap_groups(detect.detections(docs_of(spark, d)))))


@query
def occurrences(spark, d):
    docs = docs_of(spark, d)
    return candidates.occurrences(candidates.canonical(candidates.overlap_groups(detect.detections(docs))), docs)


def _judged_whole(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates counted in their whole documents, validated, put under the rules on lines and decided."""
    return context.judged_in_context(candidates.judged(cands, candidates.occurrences(cands, docs)), docs)


def extracted(docs: DataFrame) -> DataFrame:
    """The whole flow by rules: detect, merge, count, validate, rules on lines, decide, promote, add mentions that no detector saw, cap."""
    cands = candidates.canonical(candidates.overlap_groups(detect.detections(docs)))
    judged = _judged_whole(cands, docs)
    added = _judged_whole(refine.propagated(judged, detect.words(docs), cands), docs)
    flagged = docs.where(T.is_short_non_prose(F.col("text")))
    return refine.lone_capped(refine.capped(refine.promoted(judged).unionByName(added, allowMissingColumns=True)), flagged)


@query
def extract(spark, d):
    rows = extracted(docs_of(spark, d))
    return rows.select("doc_id", "line_no", F.col("start").alias("span_start"), "text", "reps", F.coalesce("failed", F.lit("-")).alias("failed"), F.col("score").cast("double").alias("score"), "decision")


@query
def extract_persons(spark, d):
    return candidates.persons(extracted(docs_of(spark, d))).withColumn("best_score", F.col("best_score").cast("double"))


@query
def reject_reason(spark, d):
    return judged_of(spark, d).select("doc_id", "line_no", F.col("start").alias("span_start"), "text", F.coalesce("failed", F.lit("-")).alias("failed"))


@query
def rule_score(spark, d):
    return judged_of(spark, d).groupBy(F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n"))


@query
def decisions(spark, d):
    return judged_of(spark, d).select("doc_id", "line_no", F.col("start").alias("span_start"), "text", "reps", F.col("score").cast("double").alias("score"), "decision")


@query
def boundary_refine(spark, d):
    names = candidates.canonical(candidates.overlap_groups(detect.bare_spans(docs_of(spark, d)))).groupBy("text").agg(F.count("*").alias("n"))
    return names.select("text", "n", F.explode(refine.split_names(F.col("text"))).alias("part")).select("text", "n", refine.rescue_edge(F.col("part")).alias("refined"))


@query
def features(spark, d):
    return refine.features(judged_of(spark, d), docs_of(spark, d))


@query
def propagate_names(spark, d):
    judged = judged_of(spark, d)
    return _spans(refine.undetected(detect.words(docs_of(spark, d)), judged, judged))


@query
def caps(spark, d):
    return refine.capped(judged_of(spark, d)).select("doc_id", "line_no", F.col("start").alias("span_start"), "text", "decision")


@query
def evidence_source(spark, d):
    return judged_of(spark, d).groupBy(refine.strongest(F.col("patterns")).alias("pattern"), "decision").agg(F.count("*").alias("n"))


@query
def persons(spark, d):
    return candidates.persons(judged_of(spark, d)).withColumn("best_score", F.col("best_score").cast("double"))


@query
def low_confidence(spark, d):
    return judged_of(spark, d).where("failed = 'corroboration'").groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@query
def document_counters(spark, d):
    return judged_of(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_candidates"), *[F.count_if(F.col("decision") == x).alias(f"n_{x}") for x in ("accepted", "review", "rejected")], F.countDistinct("key").alias("n_names"))


@query
def collection_names(spark, d):
    return candidates.collection(candidates.persons(judged_of(spark, d)))


@query
def dominance_trim(spark, d):
    counts = candidates.canonical(candidates.overlap_groups(detect.detections(docs_of(spark, d)))).groupBy(F.lower("text").alias("name")).agg(F.count("*").alias("n"))
    return candidates.dominance(counts)


@query
def scan_summary(spark, d):
    n = table(spark, d, "documents").select("doc_id")
    named = candidates.persons(judged_of(spark, d)).where("decision = 'accepted'").groupBy("doc_id").agg(F.count("*").alias("names"))
    return n.join(named, "doc_id", "left").agg(F.count("*").alias("n_documents"), F.count("names").alias("n_with_names"), F.coalesce(F.sum("names"), F.lit(0)).alias("n_names"))


def _evaluated(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    accepted = judged_of(spark, d).where("decision = 'accepted'")
    return accepted.select("doc_id", "line_no", "start", "end", "text"), fixtures.gold(fixtures.marked(docs))


@query
def gold_markup(spark, d):
    return _spans(fixtures.gold(fixtures.marked(table(spark, d, "documents").select("doc_id", "text"))))


@query
def missed_mentions(spark, d):
    accepted, gold = _evaluated(spark, d)
    return _spans(evaluate.without_overlap(gold, accepted))


@query
def false_positives(spark, d):
    accepted, gold = _evaluated(spark, d)
    return _spans(evaluate.without_overlap(accepted, gold))


@query
def overlap_metrics(spark, d):
    return evaluate.metrics(*_evaluated(spark, d))


@query
def shape_recall(spark, d):
    accepted, gold = _evaluated(spark, d)
    return evaluate.shape_recall(gold, accepted)


@query
def run_diff(spark, d):
    people = candidates.persons(judged_of(spark, d))
    half = lambda k: candidates.collection(people.where(F.col("doc_id") % 2 == k)).select("name", "decision")
    return evaluate.run_diff(half(0), half(1))


@query
def collision_audit(spark, d):
    return lexicon.collisions(lexicon.lexicon(spark))


@query
def delimiter_sniff(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.array_join(F.array("o_orderpriority", "o_orderstatus", F.lit("a,b;c")), "\u0001").alias("cells"))
    rows = rows.select("o_orderkey", F.replace("cells", F.lit("\u0001"), F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|", " "))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("line"))
    return rows.select("o_orderkey", T.delimiter(F.col("line")).alias("delimiter"))


@query
def csv_lines(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("id;name\n"), F.col("s_suppkey").cast("string"), F.lit(" ;  "), F.col("s_name"), F.lit("  x")).alias("raw"))
    return rows.select("s_suppkey", readers.csv_lines(F.col("raw"), T.delimiter(F.substring_index("raw", "\n", 1))).alias("lines"))


@query
def format_dispatch(spark, d):
    url = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, (".TXT", ".csv", ".jpeg", ".tar.JSONL", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", F.coalesce(readers.format_of(url), F.lit("-")).alias("format"))


@query
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query
def json_props_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).select("event_id", F.concat_ws(": ", "key", "value").alias("line"))


@query
def rolling_char_window(spark, d):
    return sessions.rolling_window(table(spark, d, "conversations"), 600)


def _messages(spark, d) -> DataFrame:
    """Messages with planted lines; doc_id is (conv_id, turn). The number conv_id * 10000 + turn, which isn't unique, only picks the lines."""
    m = table(spark, d, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("doc_id"), "text", "conv_id", "turn")
    return fixtures.planted(m, "conv_id", "turn").select(F.struct("conv_id", "turn").alias("doc_id"), "text")


@query
def session_roster(spark, d):
    rows = candidates.judged(candidates.canonical(candidates.overlap_groups(detect.detections(_messages(spark, d)))))
    return sessions.roster(rows.select("doc_id.conv_id", "doc_id.turn", F.col("key").alias("name"), "decision"))


@query
def newly_accepted(spark, d):
    rows = candidates.judged(candidates.canonical(candidates.overlap_groups(detect.detections(_messages(spark, d)))))
    return sessions.newly_accepted(rows.select("doc_id.conv_id", "doc_id.turn", F.col("key").alias("name"), "decision"))


@query
def feedback_dedupe(spark, d):
    people = candidates.persons(judged_of(spark, d)).select("doc_id", F.col("key").alias("name"), "decision")
    return feedback.new_records(people.where("decision = 'review'"), people.where("decision = 'accepted'"))


def _records(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, j = docs_of(spark, d), judged_of(spark, d)
    return feedback.candidate_records(j, refine.features(j, docs), docs), j


def _record_columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "line_no", F.col("start").alias("span_start"), "text", F.col("score").cast("double").alias("score"), "decision", F.col("features.char_length").alias("char_length"), F.sha2("context", 256).alias("context_sha256"))


@query
def candidate_records(spark, d):
    return _record_columns(_records(spark, d)[0])


@query
def review_records(spark, d):
    return _record_columns(feedback.review_records(*_records(spark, d)))


@query
def stratified_sample(spark, d):
    return feedback.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 25)


@query
def holdout_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return rows.orderBy("sha256", "doc_id").limit(20)


@query
def class_balance(spark, d):
    return feedback.balance(table(spark, d, "labels"), F.col("quality"))


@query
def privacy_scan(spark, d):
    return feedback.privacy_scan(table(spark, d, "documents"))


@query
def latency_quantiles(spark, d):
    e = table(spark, d, "events").where("value is not null")
    ranked = e.selectExpr("event_type", "value", "row_number() over (partition by event_type order by value) - 1 as k", "count(*) over (partition by event_type) as n")
    return ranked.where("k = floor(0.95 * (n - 1))").select("event_type", "n", F.col("value").alias("p95"))


@query
def stage_medians(spark, d):
    return evaluate.medians(table(spark, d, "events"), "event_type", "value")


def _found(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "line_no", F.col("start").alias("span_start"), "text", "decision")


@query
def context_rules(spark, d):
    docs = docs_of(spark, d)
    return context.judged_in_context(judged_of(spark, d), docs).select("doc_id", "line_no", F.col("start").alias("span_start"), "text", F.coalesce("failed", F.lit("-")).alias("failed"), F.col("score").cast("double").alias("score"), "decision")


@query
def sentence_starts(spark, d):
    docs = docs_of(spark, d)
    rows = context.with_line(detect.words(docs), docs)
    return rows.select("doc_id", "line_no", F.col("start").alias("span_start"), context.opens_sentence(F.col("prefix")).alias("opens"), context.in_quotes(F.col("prefix")).alias("quoted"))


@query
def neighbour_words(spark, d):
    rows = context.with_line(judged_of(spark, d), docs_of(spark, d))
    return rows.select("doc_id", "line_no", F.col("start").alias("span_start"), F.array_join(context.words_before(F.col("prefix")), " ").alias("before"), F.array_join(context.words_after(F.col("suffix")), " ").alias("after"))


@query
def promoted_names(spark, d):
    return _found(refine.promoted(judged_of(spark, d)))


@query
def lone_caps(spark, d):
    flagged = docs_of(spark, d).where(T.is_short_non_prose(F.col("text")))
    return _found(refine.lone_capped(judged_of(spark, d), flagged))


@query
def collection_merge(spark, d):
    return refine.merged_collection(candidates.collection(candidates.persons(judged_of(spark, d))))


@query
def person_export(spark, d):
    return export.person_rows(judged_of(spark, d))


@query
def json_export(spark, d):
    return export.document_json(candidates.persons(judged_of(spark, d)))


@query
def report_export(spark, d):
    return export.document_report(candidates.persons(judged_of(spark, d)))


def _scan(spark, d) -> DataFrame:
    files = docs_of(spark, d).select("doc_id", F.when(T.is_english(F.col("text")), "ok").otherwise("skipped: not_english").alias("status"))
    return export.scan_rows(files, candidates.persons(judged_of(spark, d)))


@query
def scan_export(spark, d):
    return _scan(spark, d)


@query
def scan_metrics(spark, d):
    return export.scan_metrics(_scan(spark, d))


@query
def one_to_one_matches(spark, d):
    accepted, gold = _evaluated(spark, d)
    return evaluate.one_to_one(gold, accepted)


@query
def promotion_gate(spark, d):
    accepted, gold = _evaluated(spark, d)
    full = accepted.where("instr(text, ' ') > 0")
    return evaluate.promotion_gate(evaluate.shape_recall(gold, accepted), evaluate.shape_recall(gold, full), evaluate.metrics(accepted, gold), evaluate.metrics(full, gold))


@query
def dictionary_recall(spark, d):
    accepted, gold = _evaluated(spark, d)
    return evaluate.shape_recall(gold, accepted, evaluate.by_dictionary)


@query
def domain_metrics(spark, d):
    return evaluate.domain_metrics(*_evaluated(spark, d), table(spark, d, "documents").select("doc_id", F.col("source").alias("domain")))


@query
def threshold_what_if(spark, d):
    scored = judged_of(spark, d).select(F.col("key").alias("name"), "decision", (F.col("score").cast("double") / 2).alias("p"))
    return evaluate.what_if(scored)


@query
def gold_labels(spark, d):
    gold = fixtures.gold(fixtures.marked(table(spark, d, "documents").select("doc_id", "text")))
    return feedback.labelled(judged_of(spark, d), gold).select("doc_id", "line_no", F.col("start").alias("span_start"), "text", "label")


@query
def gold_extension(spark, d):
    gold = fixtures.gold(fixtures.marked(table(spark, d, "documents").select("doc_id", "text")))
    return _spans(feedback.first_name_gold(gold, detect.words(docs_of(spark, d))))


@query
def weighted_training_rows(spark, d):
    rows = feedback.without_sources(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")
    return feedback.weighted(rows, F.col("source") == "web").select("doc_id", "copy")


@query
def roster_vouchers(spark, d):
    rows = candidates.judged(candidates.canonical(candidates.overlap_groups(detect.detections(_messages(spark, d)))))
    return sessions.vouched(rows.select("doc_id.conv_id", "doc_id.turn", F.col("key").alias("name"), "decision"))


@query
def classifier_scores(spark, d):
    """Trees learned from the planted mentions, then the probability of every candidate that no rule rejects."""
    docs, j = table(spark, d, "documents").select("doc_id", "text"), judged_of(spark, d)
    rows = refine.features(j, docs_of(spark, d)).withColumnRenamed("span_start", "start")
    marked = feedback.labelled(j, fixtures.gold(fixtures.marked(docs))).select("doc_id", "line_no", "start", "label")
    model = learn.train(rows.join(marked, ["doc_id", "line_no", "start"]))
    return learn.scored(rows, model).select("doc_id", "line_no", F.col("start").alias("span_start"), "p")


@query
def classified_decisions(spark, d):
    rows = judged_of(spark, d).withColumn("p", F.col("doc_id") % 10 / 10)
    return learn.decided(rows, docs_of(spark, d)).select("doc_id", "line_no", F.col("start").alias("span_start"), "text", F.col("score").cast("double").alias("score"), "decision")


@query
def folded_names(spark, d):
    tail = F.element_at(F.array(*map(F.lit, (" Žižek", " Łódź", " Straße Ærø", " Nguyễn", " Þór"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.fold_accents(F.concat("c_name", tail)).alias("folded"))


@query
def folded_lookup(spark, d):
    """Words with and without marks against the name lists: the marks of a word may go, those of a listed name may not."""
    words = ("Änna", "María", "Jöhn", "Kellér", "Łopez", "Nóvak", "Lopez", "Đavid", "Zoë", "Straße")
    word = F.concat(F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words) + 1).cast("int")), F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(""))
    key = lexicon.name_key(F.lower(word))
    return table(spark, d, "customer").select("c_custkey", word.alias("word"), key.alias("key"), lexicon.has(key, "first").alias("first_name"), lexicon.has(key, "last").alias("last_name"))


@query
def sentence_split(spark, d):
    return detect.lines(docs_of(spark, d)).select("doc_id", "line_no", F.posexplode(T.sentences(F.col("line"))).alias("ix", "sentence"))


@query
def line_chunks(spark, d):
    return docs_of(spark, d).select("doc_id", T.chunk_sizes(F.col("text"), 2000).alias("c")).select("doc_id", F.size("c").alias("n_chunks"), F.array_max("c").alias("longest"), F.element_at("c", -1).alias("last"))


@query
def entity_segments(spark, d):
    text = F.concat("p_name", F.lit(" 12b "), "p_type", F.lit("\n"), "p_brand", F.lit(" x"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(T.entity_parts(text)).alias("ix", "part"))


@query
def path_excludes(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(readers.excluded_by(F.col("url"), ["*7", "*/EN/*", "?8"]), F.lit("-")).alias("excluded_by"))


@query
def window_texts(spark, d):
    t = sessions.window_texts(table(spark, d, "conversations"), 600)
    return t.select("conv_id", "turn", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query
def span_check(spark, d):
    rows = context.with_line(judged_of(spark, d), docs_of(spark, d))
    return rows.select("doc_id", "line_no", F.col("start").alias("span_start"), (F.substring("line", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("verbatim"))


@query
def name_contexts(spark, d):
    rows = context.with_line(judged_of(spark, d), docs_of(spark, d))
    return rows.groupBy(F.col("key").alias("name")).agg(F.min_by(T.excerpt(F.col("line"), F.col("start"), F.col("end"), 80), F.struct("doc_id", "line_no", "start")).alias("excerpt"))

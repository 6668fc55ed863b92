"""The registered queries and the SQL that each of them is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import answers, arrays, text
from sparkloom.operators import evaluation, metrics, packing, records, sampling
from sparkloom.plans import synth
from sparkloom.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_TEMPLATE = "Context: x. Question: {Drug SMILES} is? (A) no (B) yes Answer:"


def _responses(spark, sf):
    return synth.responses(table(spark, sf, "labels"), table(spark, sf, "documents"))


def _voted(spark, sf):
    return evaluation.votes(evaluation.parse_samples(_responses(spark, sf)), keep=["lang", "source", "label"])


# --- answers, votes, AUROC ---------------------------------------------------------------------------------------


def _dialect(name: str) -> None:
    def run(spark, sf):
        return evaluation.parse_samples(_responses(spark, sf), name).select("item_id", "sample_idx", "pred")

    run.__name__ = f"parse_{name}"
    query(f"WITH {synth.RESPONSES}, {synth.TAIL} SELECT item_id, sample_idx::INT AS sample_idx, {synth.DIALECT[name]} AS pred FROM parsed")(run)


for _name in answers.DIALECTS:
    _dialect(_name)


@query(f"WITH {synth.RESPONSES}, {synth.TAIL} SELECT item_id, sample_idx::INT AS sample_idx, tail, ok FROM parsed")
def answer_tail(spark, sf):
    t, ok = answers.tail(F.col("response"))
    return _responses(spark, sf).select("item_id", "sample_idx", t.alias("tail"), ok.alias("ok"))


@query(f"{synth.VOTED} SELECT item_id, cnt_a, cnt_b, cnt_none, p FROM scored")
def mc_votes(spark, sf):
    return _voted(spark, sf).select("item_id", "cnt_a", "cnt_b", "cnt_none", "p")


@query(f"{synth.VOTED} SELECT sum(cnt_a)::BIGINT AS cnt_a, sum(cnt_b)::BIGINT AS cnt_b, sum(cnt_none)::BIGINT AS cnt_none, count(*) AS items, count(*) FILTER (WHERE p IS NULL) AS dropped FROM scored")
def mc_totals(spark, sf):
    return evaluation.vote_totals(_voted(spark, sf))


@query(f"{synth.VOTED} {synth.auroc_sql('scored', 'p', 'lang')}")
def mc_auroc_by_lang(spark, sf):
    return metrics.auroc(_voted(spark, sf), score="p", by=["lang"])


@query(f"{synth.VOTED} {synth.auroc_sql('scored', 'p')}")
def mc_auroc_overall(spark, sf):
    return metrics.auroc(_voted(spark, sf), score="p")


@query(
    f"{synth.VOTED} SELECT lang, CASE WHEN count(DISTINCT label) > 1 THEN true ELSE false END AS both_classes, count(*) AS items, count(p) AS valid FROM scored GROUP BY lang"
)
def mc_valid_items(spark, sf):
    return _voted(spark, sf).groupBy("lang").agg((F.count_distinct("label") > 1).alias("both_classes"), F.count("*").alias("items"), F.count("p").alias("valid"))


@query(
    f"WITH {synth.RESPONSES}, {synth.TAIL} SELECT item_id, sample_idx::INT AS sample_idx, CASE WHEN length(response) > 10 THEN substr(response, 1, 10) || '...' ELSE response END AS shown, label "
    f"FROM parsed WHERE ({synth.DIALECT['afirst']}) IS NULL ORDER BY item_id, sample_idx LIMIT 10"
)
def failed_parses_top10(spark, sf):
    return evaluation.failed_parses(evaluation.parse_samples(_responses(spark, sf)), cut=10).select("item_id", "sample_idx", "shown", "label")


_ONE = f"WITH {synth.RESPONSES}, {synth.TAIL}, one AS (SELECT *, ({synth.DIALECT['afirst']})::DOUBLE AS pred FROM parsed WHERE sample_idx = 0)"


def _one(spark, sf):
    one = evaluation.parse_samples(_responses(spark, sf).filter("sample_idx = 0"))
    return one.withColumn("pred", F.col("pred").cast("double"))


@query(f"{_ONE} {synth.auroc_sql('one', 'pred')}")
def single_sample_auroc_drop(spark, sf):
    return metrics.auroc(_one(spark, sf), score="pred")


@query(f"{_ONE} {synth.auroc_sql('(SELECT label, coalesce(pred, 0.5) AS pred FROM one)', 'pred')}")
def single_sample_auroc_half(spark, sf):
    return metrics.auroc(_one(spark, sf), score="pred", nulls="half")


_LABELLED = "labelled AS (SELECT d.doc_id, d.source, d.lang, d.n_chars::DOUBLE AS s, (d.n_chars % 1000) / 1000::DOUBLE AS p, l.quality AS label, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("s"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p"), F.col("quality").alias("label"), "toxic")


@query(f"WITH {_LABELLED} {synth.auroc_sql('labelled', 's', 'source')}")
def auroc_nchars_by_source(spark, sf):
    return metrics.auroc(_labelled(spark, sf), score="s", by=["source"])


@query(f"""WITH {_LABELLED}, c AS (
  SELECT s AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM labelled GROUP BY s
), r AS (
  SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM c WINDOW w AS (ORDER BY threshold DESC)
), t AS (
  SELECT *, lead(fp) OVER w - fp - (fp - lag(fp) OVER w) AS f, lead(tp) OVER w - tp - (tp - lag(tp) OVER w) AS t FROM r WINDOW w AS (ORDER BY threshold DESC)
)
SELECT 'Infinity'::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
UNION ALL SELECT threshold, fp / neg::DOUBLE, tp / pos::DOUBLE FROM t WHERE f IS NULL OR f <> 0 OR t <> 0""")
def roc_points(spark, sf):
    return metrics.roc_curve(_labelled(spark, sf), score="s")


@query(f"""WITH {_LABELLED}, c AS (
  SELECT source, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn,
    count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) AS n FROM labelled GROUP BY source
) SELECT *, (tp + tn) / n::DOUBLE AS accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM c""")
def accuracy_confusion(spark, sf):
    return metrics.confusion(_labelled(spark, sf), score="p", by=["source"])


@query(f"""{_ONE}, c AS (SELECT
  count(*) FILTER (WHERE pred = 0 AND label = 1) AS tp, count(*) FILTER (WHERE pred = 0 AND label = 0) AS fp, count(*) FILTER (WHERE pred = 1 AND label = 1) AS fn,
  count(*) FILTER (WHERE pred = 1 AND label = 0) AS bp FROM one
), f AS (SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1_a, CASE WHEN 2 * fn + bp + tp > 0 THEN 2 * fn / (2 * fn + bp + tp)::DOUBLE ELSE 0 END AS f1_b FROM c)
SELECT *, CASE WHEN f1_a > f1_b THEN 'A' WHEN f1_b > f1_a THEN 'B' ELSE 'same' END AS better FROM f""")
def f1_two_mappings(spark, sf):
    return metrics.f1_mappings(_one(spark, sf), choice="pred")


_TASK = "CASE WHEN source IN ('src0', 'src1') THEN 'hERG_Karim' WHEN source IN ('src2', 'src3') THEN 'Tox21_NR_AR' WHEN source = 'src4' THEN 'Tox21_SR_p53' WHEN source = 'src5' THEN 'AMES' WHEN source = 'src6' THEN 'herg_central_inhib' ELSE 'Other' END"


@query(f"""WITH {_LABELLED}, t AS (SELECT *, {_TASK} AS task FROM labelled), a AS ({synth.auroc_sql('t', 's', 'task')}), f AS (
  SELECT CASE WHEN task LIKE 'herg\\_central%' ESCAPE '\\' THEN 'herg_central' WHEN task LIKE 'Tox21%' THEN 'Tox21' WHEN task LIKE 'hERG%' THEN 'hERG' WHEN task LIKE 'AMES%' THEN 'AMES' END AS family, auroc FROM a
), m AS (SELECT family, count(*) AS n_tasks, avg(auroc) AS macro FROM f WHERE auroc IS NOT NULL GROUP BY family)
SELECT x.family, coalesce(n_tasks, 0) AS n_tasks, macro
FROM (SELECT unnest(['herg_central', 'ToxCast', 'Tox21', 'Skin_Reaction', 'hERG', 'AMES', 'DILI', 'ClinTox']) AS family) x LEFT JOIN m ON m.family = x.family""")
def macro_auroc_by_family(spark, sf):
    scored = metrics.auroc(_labelled(spark, sf).withColumn("task", F.expr(_TASK)), score="s", by=["task"])
    scored = scored.withColumn("family", registry.family(F.lit("Tox"), F.col("task")))
    families = spark.createDataFrame([(f,) for f in registry.FAMILIES["Tox"]], "family string")
    return metrics.macro_average(scored, families)


@query(f"WITH {_LABELLED} SELECT lang, min(s) AS lo, max(s) AS hi, count(*) AS n FROM labelled GROUP BY lang")
def length_extremes(spark, sf):
    return _labelled(spark, sf).groupBy("lang").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))


# --- log-probabilities ---------------------------------------------------------------------------------------------


def _logprobs(spark, sf):
    """Embeddings as log-probability vectors: token i of 64 has value e[i]."""
    e = table(spark, sf, "embeddings")
    values = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    entries = F.arrays_zip(F.sequence(F.lit(0), F.size(values) - 1).alias("k"), values.alias("v"))
    return e.select(F.col("vec_id").alias("item_id"), (F.col("label") % 2).alias("label"), F.map_from_entries(entries).alias("logprobs"), values.alias("v"))


_NEXT = """v AS (SELECT vec_id AS item_id, label % 2 AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
top AS (SELECT *, list_transform(list_sort(list_transform(range(1, 65), lambda i: {'v': v[i], 'k': i - 1}), 'DESC')[1:40], lambda s: s.k) AS kept FROM v),
lp AS (SELECT item_id, label,
  list_max(list_transform(list_filter([1, 5, 7], lambda i: list_contains(kept, i)), lambda i: v[i + 1])) AS lp_a,
  list_max(list_transform(list_filter([2, 6], lambda i: list_contains(kept, i)), lambda i: v[i + 1])) AS lp_b FROM top),
scored AS (SELECT *, 1 / (1 + exp(-(lp_b - lp_a))) AS p_b FROM lp WHERE lp_a IS NOT NULL AND lp_b IS NOT NULL)"""


def _next(spark, sf):
    return evaluation.next_token(_logprobs(spark, sf), [1, 5, 7, 5], [2, 6], k=40)


@query(f"WITH {_NEXT} SELECT item_id, label, lp_a, lp_b, round(p_b, 9) AS p_b FROM scored")
def nexttoken_scores(spark, sf):
    return _next(spark, sf).select("item_id", "label", "lp_a", "lp_b", F.round("p_b", 9).alias("p_b"))


@query(f"WITH {_NEXT} {synth.auroc_sql('(SELECT label, round(p_b, 9) AS p_b FROM scored)', 'p_b')}")
def nexttoken_auroc(spark, sf):
    return metrics.auroc(_next(spark, sf).withColumn("p_b", F.round("p_b", 9)), score="p_b")


# Fixed values of the test: four variants of two options, as windows of the vector.
_OPTIONS = [("A", 1), ("A", 9), ("B", 17), ("B", 25)]
_SEQ = """v AS (SELECT vec_id AS item_id, label % 2 AS label, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE < 0.4 THEN x::DOUBLE END) AS v FROM embeddings),
o AS (SELECT * FROM (VALUES ('A', 1), ('A', 9), ('B', 17), ('B', 25)) t(option, pos)),
lp AS (SELECT item_id, label, option, CASE WHEN list_count(v[pos:pos + 3]) = 4 THEN v[pos] + v[pos + 1] + v[pos + 2] + v[pos + 3] END AS lp FROM v, o),
best AS (SELECT item_id, label, max(lp) FILTER (WHERE option = 'A') AS lp_a, max(lp) FILTER (WHERE option = 'B') AS lp_b FROM lp GROUP BY ALL),
scored AS (SELECT *, round(1 / (1 + exp(-(lp_b - lp_a))), 9) AS p_b FROM best WHERE lp_a IS NOT NULL AND lp_b IS NOT NULL)"""


def _options(spark, sf):
    items = _logprobs(spark, sf).withColumn("v", F.transform("v", lambda x: F.when(x < 0.4, x)))
    pairs = evaluation.option_sequences(items, spark.createDataFrame(_OPTIONS, "option string, pos int"))
    scored = pairs.withColumn("lp", arrays.sequence_logprob(F.slice("v", F.col("pos"), F.lit(4))))
    return evaluation.option_scores(scored, keep=["label"]).withColumn("p_b", F.round("p_b", 9))


@query(f"WITH {_SEQ} SELECT item_id, label, round(lp_a, 9) AS lp_a, round(lp_b, 9) AS lp_b, p_b FROM scored")
def optseq_scores(spark, sf):
    return _options(spark, sf).select("item_id", "label", F.round("lp_a", 9).alias("lp_a"), F.round("lp_b", 9).alias("lp_b"), "p_b")


@query(f"WITH {_SEQ} {synth.auroc_sql('scored', 'p_b')}")
def optseq_auroc(spark, sf):
    return metrics.auroc(_options(spark, sf), score="p_b")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm, array_to_string(list_transform(embedding[1:10], lambda x: printf('%.4f', x::DOUBLE)), ' ') AS head FROM embeddings")
def embedding_norms(spark, sf):
    head = F.array_join(F.transform(F.slice("embedding", 1, 10), lambda x: F.format_string("%.4f", x.cast("double"))), " ")
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.norm(F.col("embedding")), 9).alias("norm"), head.alias("head"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def argmax_prediction(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("best"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS tok FROM documents), c AS (SELECT tok, count(*) AS n FROM t GROUP BY tok),
i AS (SELECT tok, n, ('0x' || substr(md5(tok), 1, 7))::BIGINT % 32000 % (SELECT count(*) FROM embeddings) AS vec_id FROM c)
SELECT tok, n, vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm FROM i JOIN embeddings USING (vec_id)""")
def token_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    tokens = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    at = F.get(arrays.token_ids(F.array("tok")), 0) % e.count()
    return tokens.withColumn("vec_id", at.cast("long")).join(e, "vec_id").select("tok", "n", "vec_id", F.round(arrays.norm(F.col("embedding")), 9).alias("norm"))


@query("""SELECT d.doc_id, replace('Context: x. Question: {Drug SMILES} is? (A) no (B) yes Answer:', 'Answer:', 'Here are some structured reasoning examples for your reference: ' || chr(10) || 'example1:' || chr(10) || 'one' || chr(10) || chr(10) ||
  'example2:' || chr(10) || 'two' || '.' || chr(10) || ' Please follow the structured reasoning examples to think step by step and then put ONLY your final choice ((A) or (B)) after "Answer:"') || d.source AS prompt FROM documents d""")
def few_shot_prompts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(text.ask_with_examples(F.lit(_TEMPLATE), ["one", "two"]), F.col("source")).alias("prompt"))


# --- robustness ------------------------------------------------------------------------------------------------------

_VARIANTS = """v AS (SELECT user_id AS parent_id, (user_id % 2)::INT AS label, round(1 / (1 + exp(-(value / 50.0::DOUBLE - 1))), 9) AS p_b FROM events),
r AS (SELECT parent_id, label, count(*) AS n_variants, min(p_b) AS p_min, max(p_b) AS p_max, max(p_b) - min(p_b) AS p_range,
  CASE WHEN label = 1 THEN max(p_b) ELSE min(p_b) END AS best, CASE WHEN label = 1 THEN min(p_b) ELSE max(p_b) END AS worst FROM v GROUP BY parent_id, label)"""


def _variants(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("parent_id"), (F.col("user_id") % 2).cast("int").alias("label"), F.round(arrays.sigmoid(F.col("value") / 50.0 - 1), 9).alias("p_b"))


@query(f"WITH {_VARIANTS} SELECT * FROM r")
def robust_ranges(spark, sf):
    return evaluation.variant_ranges(_variants(spark, sf))


@query(f"WITH {_VARIANTS} SELECT count(*) AS parents, round(avg(p_range), 9) AS mean, round(stddev_pop(p_range), 9) AS std, round(median(p_range), 9) AS median, max(p_range) AS max FROM r")
def robust_range_stats(spark, sf):
    s = evaluation.range_stats(evaluation.variant_ranges(_variants(spark, sf)))
    return s.select("parents", *[F.round(c, 9).alias(c) for c in ("mean", "std", "median")], "max")


@query(f"WITH {_VARIANTS} SELECT 'best' AS pick, * FROM ({synth.auroc_sql('r', 'best')}) UNION ALL SELECT 'worst' AS pick, * FROM ({synth.auroc_sql('r', 'worst')})")
def robust_best_worst(spark, sf):
    r = evaluation.variant_ranges(_variants(spark, sf))
    one = lambda c: metrics.auroc(r, score=c).select(F.lit(c).alias("pick"), "n_pos", "n_neg", "auroc")
    return one("best").unionByName(one("worst"))


@query(f"""WITH {_VARIANTS}, e AS (SELECT min(p_range) AS mn, max(p_range) AS mx FROM r),
b AS (SELECT least(39, floor((p_range - mn) / (mx - mn) * 40))::INT AS bin, count(*) AS n FROM r, e GROUP BY 1)
SELECT x.bin::INT AS bin, round(mn + (mx - mn) * x.bin / 40, 9) AS low, round(mn + (mx - mn) * (x.bin + 1) / 40, 9) AS high, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(40)) AS bin) x LEFT JOIN b ON b.bin = x.bin""")
def robust_hist40(spark, sf):
    h = metrics.histogram(evaluation.variant_ranges(_variants(spark, sf)), "p_range")
    return h.select("bin", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n")


@query(f"WITH {_VARIANTS} SELECT count(*) / greatest(1, count(DISTINCT parent_id))::DOUBLE AS per_parent, count(DISTINCT parent_id) AS parents FROM v")
def variants_per_parent(spark, sf):
    parents = F.count_distinct("parent_id")
    return _variants(spark, sf).agg((F.count("*") / F.greatest(F.lit(1), parents)).alias("per_parent"), parents.alias("parents"))


@query(f"WITH {_VARIANTS} SELECT parent_id, array_to_string(list_sort(list_distinct(list(printf('%.9f', p_b)))), ' ') AS scores FROM v GROUP BY parent_id")
def scores_per_parent(spark, sf):
    return _variants(spark, sf).groupBy("parent_id").agg(F.array_join(F.sort_array(F.collect_set(F.format_string("%.9f", "p_b"))), " ").alias("scores"))


# --- prompts and records -----------------------------------------------------------------------------------------

_CHAT = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"


def _chats(spark, sf):
    messages = F.collect_list(F.struct("turn", "role", "text"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(messages.alias("messages"))


@query(f"SELECT conv_id, {_CHAT} AS rendered FROM conversations GROUP BY conv_id")
def render_chatml(spark, sf):
    return _chats(spark, sf).select("conv_id", text.render_chat(F.col("messages")).alias("rendered"))


@query(f"SELECT conv_id, {_CHAT} || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) AS prompt FROM conversations WHERE role <> 'assistant' GROUP BY conv_id")
def generation_prompts(spark, sf):
    c = table(spark, sf, "conversations").filter("role <> 'assistant'").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("m"))
    return c.select("conv_id", F.concat(text.render_chat(F.col("m")), text.generation_prompt()).alias("prompt"))


@query(f"WITH r AS (SELECT conv_id, {_CHAT} AS t FROM conversations GROUP BY conv_id) SELECT conv_id, split_part(t, 'assistant', 1) || 'assistant' AS input, split_part(t, 'assistant', 2) AS output FROM r")
def render_gpt_record(spark, sf):
    source, target = text.split_reply(text.render_chat(F.col("messages")))
    return _chats(spark, sf).select("conv_id", source.alias("input"), target.alias("output"))


_PROMPT = "replace('Context: x. Question: {Drug SMILES} is? (A) no (B) yes Answer:', '{Drug SMILES}', '<SMILES>' || d.text || '</SMILES>')"


def _prompts(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.withColumn("prompt", text.fill(F.lit(_TEMPLATE), {"{Drug SMILES}": (F.col("text"), "SMILES")}))


@query(f"SELECT d.doc_id, {_PROMPT} AS instruction, '' AS input, CASE l.toxic WHEN 1 THEN '(B)' WHEN 0 THEN '(A)' END AS output FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def render_alpaca(spark, sf):
    return _prompts(spark, sf).select("doc_id", *records.alpaca(F.col("prompt"), F.col("toxic")))


@query(f"""SELECT d.doc_id, '<|im_start|>user' || chr(10) || {_PROMPT} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' AS input,
  chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || CASE l.toxic WHEN 1 THEN '(B)' ELSE '(A)' END || '<|im_end|>' || chr(10) AS output
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def build_gpt_records(spark, sf):
    return _prompts(spark, sf).select("doc_id", *records.gpt(F.col("prompt"), text.choice(F.col("toxic")), strict=True))


@query(f"SELECT d.doc_id, replace({_PROMPT}, 'Answer:', '{text.STEPS}') AS prompt FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def inject_steps(spark, sf):
    return _prompts(spark, sf).select("doc_id", text.ask_for_steps(F.col("prompt")).alias("prompt"))


@query("SELECT doc_id, replace(replace('P1 {Protein1 amino acid sequence} P2 {Protein2 amino acid sequence}', '{Protein1 amino acid sequence}', '<FASTA>' || split_part(text, 'e', 1) || '</FASTA>'), '{Protein2 amino acid sequence}', '<FASTA>' || lang || '</FASTA>') AS prompt FROM documents")
def wrap_placeholders(spark, sf):
    marks = {"{Protein1 amino acid sequence}": (text.before(F.col("text"), "e"), "FASTA"), "{Protein2 amino acid sequence}": (F.col("lang"), "FASTA")}
    template = F.lit("P1 {Protein1 amino acid sequence} P2 {Protein2 amino acid sequence}")
    return table(spark, sf, "documents").select("doc_id", text.fill(template, marks).alias("prompt"))


_TEMPLATES = [("en", "English: {x} (A) or (B)"), ("de", "Deutsch: {x}"), ("fr", "ToxCast {x}"), ("es", "Tox21 {x} (A)")]
_TEMPLATE_SQL = "tpl AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TEMPLATES) + ") t(lang, template))"


@query(f"WITH {_TEMPLATE_SQL} SELECT d.doc_id, replace(t.template, '{{x}}', d.source) AS prompt FROM documents d JOIN tpl t ON t.lang = d.lang")
def template_join(spark, sf):
    templates = spark.createDataFrame(_TEMPLATES, "prompt_key string, template string")
    rows = records.with_templates(table(spark, sf, "documents").withColumn("prompt_key", F.col("lang")), templates)
    return rows.select("doc_id", text.put(F.col("template"), "{x}", F.col("source")).alias("prompt"))


@query(f"WITH {_TEMPLATE_SQL} SELECT lang AS prompt_key FROM tpl WHERE NOT contains(template, '(A)') AND NOT starts_with(template, 'ToxCast') AND NOT starts_with(template, 'Tox21')")
def regression_templates(spark, sf):
    t = spark.createDataFrame(_TEMPLATES, "prompt_key string, template string")
    keep = ~F.col("template").contains("(A)") & ~F.col("template").startswith("ToxCast") & ~F.col("template").startswith("Tox21")
    return t.filter(keep).select("prompt_key")


@query("SELECT doc_id, trim(text || CASE WHEN length(source) > 0 THEN chr(10) || source ELSE '' END, ' ' || chr(10) || chr(9) || chr(13)) AS user_text FROM documents")
def user_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.user_text(F.col("text"), F.col("source")).alias("user_text"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS cut, substr(text, 1, 80) || '...' AS always FROM documents")
def truncate_with_ellipsis(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 100).alias("cut"), text.clip(F.col("text"), 80, always=True).alias("always"))


@query("SELECT page_id, split_part(url, '/', -1) AS base, split_part(url, '/', 1) AS scheme FROM pages")
def basenames(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.after_last(F.col("url"), "/").alias("base"), text.before(F.col("url"), "/").alias("scheme"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def date_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"))


@query("""WITH m AS (SELECT event_type, min(value) AS mn, max(value) AS mx FROM events GROUP BY event_type)
SELECT event_id, CASE WHEN mn = mx THEN 0 ELSE greatest(0, least(1000, round_even((value - mn) / (mx - mn) * 1000, 0)))::INT END AS scaled,
  printf('%03d', CASE WHEN mn = mx THEN 0 ELSE greatest(0, least(1000, round_even((value - mn) / (mx - mn) * 1000, 0)))::INT END) AS shown
FROM events JOIN m ON m.event_type = events.event_type""")
def scale_0_1000(spark, sf):
    e = table(spark, sf, "events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    scaled = text.scale_1000(F.col("value"), F.col("mn"), F.col("mx"))
    return e.join(F.broadcast(ends), "event_type").select("event_id", scaled.alias("scaled"), text.three_digits(scaled).alias("shown"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'Answer: ' || json_extract_string(props, '$.k') AS answer FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").filter(k.isNotNull()).select("event_id", k.alias("k"), F.concat(F.lit("Answer: "), k).alias("answer"))


def _cot_sql() -> str:
    """The answer of each file's form, by the number of the file."""
    shown = lambda title, value: f"'Answer: ' || {value}" if not title else f"'Answer: ' || chr(10) || '{{' || chr(10) || '    ‘{title}’: ' || {value} || ',' || chr(10) || '}}'"
    value = {"reference": "n_chars", "gt": "'[' || n_chars || ', ''' || lang || ''']'", "output": "'it''s ' || lang"}
    return " ".join(f"WHEN {i} THEN {shown(title, value[field])}" for i, (title, field) in enumerate(records.COT_ANSWERS.values()))


@query(f"""SELECT doc_id, '<think>' || chr(10) || 'lang:' || chr(10) || lang || chr(10) || 'output:' || chr(10) || 'it''s ' || lang || chr(10) || 'n:' || chr(10) || n_chars || chr(10) ||
  'even:' || chr(10) || CASE WHEN n_chars % 2 = 0 THEN 'True' ELSE 'False' END || chr(10) || 'none:' || chr(10) || 'None' || chr(10) ||
  'list:' || chr(10) || '[' || n_chars || ', \"it''s\", None, {{''source'': ''' || source || '''}}, 0.5]' || chr(10) || '</think>' || chr(10) ||
  CASE doc_id % {len(records.COT_ANSWERS)} {_cot_sql()} END AS output FROM documents""")
def cot_records(spark, sf):
    d = table(spark, sf, "documents")
    file = F.element_at(F.array(*[F.lit(f) for f in records.COT_ANSWERS]), (F.col("doc_id") % len(records.COT_ANSWERS) + 1).cast("int"))
    n, lang, source = F.col("n_chars").cast("string"), F.col("lang"), F.col("source")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    even = F.when(F.col("n_chars") % 2 == 0, "true").otherwise("false")
    cot = join('{"lang":"', lang, '","output":"it\'s ', lang, '","n":', n, ',"even":', even, ',"none":null,"list":[', n, ',"it\'s",null,{"source":"', source, '"},0.5]}')
    meta = join('{"reference":"', n, '","gt":[', n, ',"', lang, '"]}')
    return d.select("doc_id", records.cot_answer(file, cot, meta).alias("output"))


@query("SELECT doc_id, 'AB' || lang AS heavy, source AS light FROM documents")
def pair_literals(spark, sf):
    literal = F.concat(F.lit("['AB"), F.col("lang"), F.lit("', '"), F.col("source"), F.lit("']"))
    both = text.pair(literal)
    return table(spark, sf, "documents").select("doc_id", F.element_at(both, 1).alias("heavy"), F.element_at(both, 2).alias("light"))


# --- tasks -----------------------------------------------------------------------------------------------------------

_LABEL_SETS = {"Tox21": ["NR-AR", "SR-p53"], "herg_central": ["hERG_at_1uM", "hERG_inhib"], "ToxCast": ["ACEA_T47D"]}
_TASK_ROWS = [(g, t) for g, ts in registry.TASKS.items() for t in ts] + [("Tox", t) for t in ("Tox21_NR_AR", "Tox21_SR_p53", "herg_central_hERG_inhib", "ToxCast_ACEA_T47D")]


@query(
    "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{t}')" for g, t in _TASK_ROWS) + """) t(task_group, task))
SELECT task_group, task, CASE WHEN task = 'Weber' THEN 'weber' WHEN starts_with(task, 'herg_central') THEN 'herg_central' ELSE replace(task, '-', '_') END AS prompt_key,
  CASE WHEN starts_with(task, 'ToxCast') THEN replace(task, 'ToxCast_', '') WHEN starts_with(task, 'herg_central') THEN replace(task, 'herg_central_', '')
       WHEN starts_with(task, 'Tox21') THEN replace(replace(task, 'Tox21_', ''), '_', '-') END AS loader_label,
  CASE WHEN task_group = 'HTS' AND ends_with(task, 'butkiewicz') THEN 'butkiewicz' WHEN task = 'Carcinogens_Lagunin' THEN NULL WHEN starts_with(task, 'hERG') THEN 'hERG'
       WHEN starts_with(task, 'herg_central') THEN 'herg_central' WHEN starts_with(task, 'Tox21') THEN 'Tox21' WHEN starts_with(task, 'ToxCast') THEN 'ToxCast' ELSE task END AS family FROM t"""
)
def task_registry(spark, sf):
    t = registry.tasks(spark, _LABEL_SETS)
    return t.select("task_group", "task", registry.prompt_key(F.col("task")).alias("prompt_key"), registry.loader_label(F.col("task")).alias("loader_label"), registry.family(F.col("task_group"), F.col("task")).alias("family"))


@query("SELECT task_group, count(*) AS n FROM (VALUES " + ", ".join(f"('{g}')" for g in ("ADME", "HTS") for _ in registry.TASKS[g]) + ") t(task_group) GROUP BY 1")
def task_groups(spark, sf):
    return registry.tasks(spark, groups=["ADME", "HTS"]).groupBy("task_group").agg(F.count("*").alias("n"))


# --- splits, samples, sets ---------------------------------------------------------------------------------------

_BUCKET = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10)"
_SPLIT = f"CASE WHEN {_BUCKET} < 7 THEN 'train' WHEN {_BUCKET} < 8 THEN 'valid' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def split_712(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sampling.split(F.col("doc_id")).alias("split"))


@query(f"SELECT x.split, coalesce(n, 0) AS n FROM (SELECT unnest(['train', 'valid', 'test', 'extra']) AS split) x LEFT JOIN (SELECT {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1) s ON s.split = x.split")
def split_counts(spark, sf):
    wanted = spark.createDataFrame([("train",), ("valid",), ("test",), ("extra",)], "split string")
    counts = table(spark, sf, "documents").groupBy(sampling.split(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"))
    return wanted.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH pos AS (SELECT DISTINCT c_nationkey AS l, o_custkey AS r FROM orders JOIN customer ON c_custkey = o_custkey ),
rights AS (SELECT r, row_number() OVER (ORDER BY md5(r::VARCHAR || '/42'), r) - 1 AS no FROM (SELECT DISTINCT r FROM pos)), m AS (SELECT greatest(count(*), 1) AS m FROM rights),
drawn AS (SELECT DISTINCT l, ('0x' || substr(md5(l || '/' || r || '/' || draw || '/42'), 1, 8))::BIGINT % m AS no FROM pos, m, (SELECT unnest(range(1, 9)) AS draw) d),
free AS (SELECT d.l, x.r FROM drawn d JOIN rights x ON x.no = d.no ANTI JOIN pos p ON p.l = d.l AND p.r = x.r),
neg AS (SELECT l, r, 0 AS label FROM free ORDER BY md5(l || '/' || r || '/42'), l, r LIMIT (SELECT count(*) FROM pos))
SELECT l, r, 1 AS label FROM pos UNION ALL SELECT * FROM neg""")
def pair_neg_sample(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return sampling.negatives(o.select(F.col("c_nationkey").alias("l"), F.col("o_custkey").alias("r")).distinct(), "l", "r")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '/42'), doc_id LIMIT 50")
def shuffled_head(spark, sf):
    return sampling.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id").limit(50)


@query("SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_texts(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")).select(F.md5("text").alias("text_md5"), "copies", "doc_id")


@query("SELECT true AS same, false AS other")
def set_equality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    differ = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n"))
    same, other = differ(d, sampling.shuffled(d, "doc_id")), differ(d, d.filter("doc_id > 3"))
    return same.select((F.col("n") == 0).alias("same")).crossJoin(other.select((F.col("n") == 0).alias("other")))


@query("SELECT doc_id AS id, lang AS task, source AS input FROM documents UNION ALL SELECT item_id, 'benchmark', '' FROM benchmark UNION ALL SELECT page_id, 'page', url FROM pages")
def task_union(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("task"), F.col("source").alias("input"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("task"), F.lit("").alias("input"))
    return d.unionByName(b).unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("task"), F.col("url").alias("input")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def sort_by_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("SELECT lang, doc_id, place::INT AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 3")
def first_k_per_group(spark, sf):
    return evaluation.first_of_each(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 3)


_CHUNKS = "SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INT AS place, floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 16)::INT AS chunk FROM documents"


@query(_CHUNKS)
def chunk_ids(spark, sf):
    return sampling.chunk_ids(table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", 16, ["lang"])


@query(f"SELECT lang, doc_id, place, chunk FROM (SELECT *, count(*) OVER (PARTITION BY lang, chunk) AS n FROM ({_CHUNKS})) WHERE n = 16")
def drop_last(spark, sf):
    return sampling.chunk_ids(table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", 16, ["lang"], drop_last=True)


@query(f"SELECT lang, doc_id FROM ({_CHUNKS}) WHERE (place + 1) % 10 = 0")
def every_tenth(spark, sf):
    return sampling.chunk_ids(table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", 16, ["lang"]).filter((F.col("place") + 1) % 10 == 0).select("lang", "doc_id")


@query("SELECT doc_id AS id, text AS prompt, source AS response FROM documents WHERE lang = 'en'")
def column_map_filter(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), F.col("source").alias("response"))


@query("SELECT b.item_id AS idx, b.text AS sentence1, d.text AS sentence2, (d.doc_id % 2)::INT AS labels, ceil(greatest(length(b.text), length(d.text)) / 16.0)::INT * 16 AS width FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def pair_prep(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("sentence1"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("sentence2"), (F.col("doc_id") % 2).cast("int").alias("label"))
    width = arrays.ceil_to(F.greatest(F.length("sentence1"), F.length("sentence2")), 16)
    return b.join(d, "idx").withColumnRenamed("label", "labels").withColumn("width", width)


@query("SELECT c_custkey, c_name || '.' || c_nationkey AS joined FROM customer")
def joined_columns(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", records.joined(c, "c_na").alias("joined"))


# --- tokens, masks, packing ----------------------------------------------------------------------------------------

_TOK = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]|[ \t\r\n]+'"
_IDS = "list_transform(regexp_extract_all({x}, " + _TOK + "), lambda t: (('0x' || substr(md5(t), 1, 7))::BIGINT % 32000)::INT)"


@query(f"""WITH p AS (SELECT b.item_id AS idx, b.item_id // 16 AS batch, (d.doc_id % 2)::INT AS labels, {_IDS.format(x="b.text")} || [2] || {_IDS.format(x="d.text")} || [2] AS ids FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
w AS (SELECT batch, (ceil(max(len(ids)) / 8.0) * 8)::INT AS width FROM p GROUP BY batch)
SELECT idx, batch, labels, width, array_to_string(list_resize(ids, width, 0), ' ') AS input_ids FROM p JOIN w USING (batch)""")
def pair_tokens(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("sentence1"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("sentence2"), (F.col("doc_id") % 2).cast("int").alias("labels"))
    rows = records.pair_tokens(b.join(d, "idx")).withColumn("batch", F.floor(F.col("idx") / 16))
    out = packing.collate(rows, "batch", pad=0, multiple=packing.pad_multiple("bf16"), labels=None)
    return out.select("idx", "batch", "labels", "width", F.array_join("input_ids", " ").alias("input_ids"))
_REC = f"""p AS (SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, role, text FROM conversations),
rec AS (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS instruction, reply AS output FROM p WHERE role = 'user' AND next = 'assistant'),
ids AS (SELECT conv_id, turn, {_IDS.format(x="'<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)")} AS a, {_IDS.format(x="output || '<|im_end|>' || chr(10)")} AS b FROM rec),
tok AS (SELECT conv_id, turn, (a || b || [2])[1:2048] AS input_ids, (list_transform(a, lambda x: -100) || b || [2])[1:2048] AS labels FROM ids)"""


def _tokens(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("output", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    rows = c.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), F.lit("").alias("input"), "output")
    return records.tokens_and_labels(rows, eos=2, most=2048).select("conv_id", "turn", "input_ids", "labels")


_JOIN = "array_to_string({0}, ' ') AS {0}"


@query(f"WITH {_REC} SELECT conv_id, turn, {_JOIN.format('input_ids')}, {_JOIN.format('labels')} FROM tok")
def label_mask(spark, sf):
    return _tokens(spark, sf).select("conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


@query(f"""WITH {_REC}, w AS (SELECT conv_id, (ceil(max(len(input_ids)) / 16.0) * 16)::INT AS width FROM tok GROUP BY conv_id)
SELECT conv_id, turn, width, array_to_string(list_resize(input_ids, width, 0), ' ') AS input_ids, array_to_string(list_resize(labels, width, -100), ' ') AS labels,
  array_to_string(list_transform(list_resize(input_ids, width, 0), lambda x: (x <> 0)::INT), ' ') AS attention_mask FROM tok JOIN w USING (conv_id)""")
def pad_collate16(spark, sf):
    out = packing.collate(_tokens(spark, sf), "conv_id", pad=0)
    return out.select("conv_id", "turn", "width", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "labels", "attention_mask")])


_LEN = "n AS (SELECT (doc_id % 16)::INT AS shard, doc_id, (n_chars % 3000 + 1)::INT AS n FROM documents)"


def _lengths(spark, sf):
    return table(spark, sf, "documents").select((F.col("doc_id") % 16).cast("int").alias("shard"), "doc_id", (F.col("n_chars") % 3000 + 1).cast("int").alias("n"))


@query(f"""WITH RECURSIVE {_LEN}, o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS rn FROM n), f AS (
  SELECT shard, doc_id, n, rn, 0 AS pack, n::BIGINT AS fill FROM o WHERE rn = 1
  UNION ALL SELECT o.shard, o.doc_id, o.n, o.rn, CASE WHEN f.fill + o.n > 4096 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.fill + o.n > 4096 THEN o.n ELSE f.fill + o.n END
  FROM f JOIN o ON o.shard = f.shard AND o.rn = f.rn + 1
) SELECT shard, doc_id, n, pack FROM f""")
def pack_nextfit(spark, sf):
    return packing.pack_next_fit(_lengths(spark, sf), "shard", "doc_id", "n", 4096)


@query()
def pack_firstfit(spark, sf):
    return packing.pack_first_fit(_lengths(spark, sf), "shard", "doc_id", "n", 4096)


@query(f"""WITH {_LEN}, o AS (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY doc_id) AS upto, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS rn FROM n),
k AS (SELECT * FROM o WHERE rn = 1 OR upto <= 4096), t AS (SELECT shard, count(*)::INT AS kept, sum(n)::BIGINT AS fill, list(n ORDER BY rn) AS segs FROM k GROUP BY shard),
p AS (SELECT shard, kept, fill, ((-fill % 8) + 8) % 8 AS gap, segs FROM t), s AS (SELECT shard, kept, fill + gap AS total, CASE WHEN gap > 0 THEN segs || [gap::INT] ELSE segs END AS segs FROM p)
SELECT shard, kept, total::BIGINT AS total, array_to_string(segs, ' ') AS seg_lens, array_to_string([0] || list_transform(range(1, len(segs) + 1), lambda i: list_sum(segs[1:i])::BIGINT), ' ') AS cu_seqlens, list_max(segs)::BIGINT AS max_seqlen FROM s""")
def varlen_align8(spark, sf):
    lists = _lengths(spark, sf).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("x"))
    v = lists.select("shard", packing.varlen(F.transform("x", lambda s: s["n"].cast("long")), 4096).alias("v")).select("shard", "v.*")
    return v.select("shard", "kept", "total", F.array_join("seg_lens", " ").alias("seg_lens"), F.array_join("cu_seqlens", " ").alias("cu_seqlens"), "max_seqlen")


@query(f"""WITH RECURSIVE {_LEN}, o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS rn FROM n), f AS (
  SELECT shard, doc_id, n, rn, 0 AS pack, n::BIGINT AS fill FROM o WHERE rn = 1
  UNION ALL SELECT o.shard, o.doc_id, o.n, o.rn, CASE WHEN f.fill + o.n > 4096 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.fill + o.n > 4096 THEN o.n ELSE f.fill + o.n END
  FROM f JOIN o ON o.shard = f.shard AND o.rn = f.rn + 1
), t AS (SELECT shard, pack, count(*)::INT AS kept, sum(n)::BIGINT AS fill, list(n ORDER BY rn) AS segs FROM f GROUP BY shard, pack),
p AS (SELECT shard, pack, kept, fill, ((-fill % 8) + 8) % 8 AS gap, segs FROM t)
SELECT shard, pack, kept, (fill + gap)::BIGINT AS total, array_to_string(CASE WHEN gap > 0 THEN segs || [gap::INT] ELSE segs END, ' ') AS seg_lens FROM p""")
def varlen_carry_over(spark, sf):
    v = packing.varlen_carried(_lengths(spark, sf), "shard", "doc_id", "n", 4096)
    return v.select("shard", "pack", "kept", "total", F.array_join("seg_lens", " ").alias("seg_lens"))


_SEGS = "s AS (SELECT doc_id, [(n_chars % 5 + 1)::INT, (n_chars % 3 + 1)::INT, 2] AS segs FROM documents)"


def _segments(spark, sf):
    segs = F.array((F.col("n_chars") % 5 + 1).cast("int"), (F.col("n_chars") % 3 + 1).cast("int"), F.lit(2))
    return table(spark, sf, "documents").select("doc_id", segs.alias("segs"))


@query(f"""WITH {_SEGS} SELECT doc_id, array_to_string([0, segs[1], segs[1] + segs[2], segs[1] + segs[2] + 2], ' ') AS cu_seqlens,
  array_to_string(range(segs[1]) || range(segs[2]) || range(2), ' ') AS input_pos FROM s""")
def cu_seqlens(spark, sf):
    join = lambda c, n: F.array_join(c, " ").alias(n)
    return _segments(spark, sf).select("doc_id", join(arrays.running_sum(F.col("segs")), "cu_seqlens"), join(arrays.positions(F.col("segs")), "input_pos"))


@query(f"""WITH {_SEGS}, x AS (SELECT doc_id, unnest(list_transform(range(segs[1]), lambda i: [0, i]) || list_transform(range(segs[2]), lambda i: [segs[1], segs[1] + i]) ||
  list_transform(range(2), lambda i: [segs[1] + segs[2], segs[1] + segs[2] + i])) AS p FROM s) SELECT doc_id, p[1]::INT AS first, p[2]::INT AS last FROM x""")
def block_causal_spans(spark, sf):
    return _segments(spark, sf).select("doc_id", F.explode(arrays.block_causal(F.col("segs"))).alias("p")).select("doc_id", "p.first", "p.last")


@query("SELECT lang, (ceil(max(n_chars) / 16.0) * 16)::INT AS width, ((-sum(n_chars) % 8 + 8) % 8)::BIGINT AS gap FROM documents GROUP BY lang")
def ceil_and_gap(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(arrays.ceil_to(F.max("n_chars"), 16).alias("width"), arrays.gap_to(F.sum("n_chars"), 8).alias("gap"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: x = 'the'))::INT AS n, length(replace(text, 'the', '')) AS left_over FROM documents WHERE list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), 'the')")
def token_scan(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    d = table(spark, sf, "documents").filter(F.array_contains(words, "the"))
    return d.select("doc_id", F.size(F.filter(words, lambda x: x == "the")).alias("n"), F.length(F.replace("text", F.lit("the"), F.lit(""))).cast("long").alias("left_over"))

"""Queries of evaluation, layout and incremental work. Papers, gold answers and predictions are made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import evaluation as ev
from lectern.operators import layout
from lectern.plans.catalog import Tables, query
from lectern.plans.queries_retrieval import GRADE
from lectern.plans.queries_text import SENTENCES, norm_sql
from lectern.streaming import incremental as inc
from lectern.streaming import state


def _gold(t: Tables) -> DataFrame:
    """Two annotations a document: its first line, and a yes/no."""
    return t.documents.selectExpr("doc_id as question_id", "explode(array(named_struct('n', 0, 'answer', split(text, '\\n')[0], 'type', 'extractive', 'evidence', slice(split(text, '\\n'), 1, 2)), named_struct('n', 1, 'answer', if(doc_id % 2 = 0, 'Yes', 'No'), 'type', 'boolean', 'evidence', array(split(text, '\\n')[0])))) as g").select("question_id", "g.*")


def _predictions(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 10 <> 9").selectExpr("doc_id as question_id", "if(doc_id % 3 = 0, 'yes', concat(split(text, '\\n')[0], ' the end')) as predicted_answer", "split(text, '\\n') as predicted_evidence")


_B = "list_filter(string_split({}, ' '), lambda x: x <> '')"
SCORES = f"""go AS (SELECT doc_id AS question_id, string_split(text, chr(10)) AS l, doc_id, text FROM documents),
       gd AS (SELECT question_id, 0 AS n, l[1] AS answer, 'extractive' AS type, l[1:2] AS evidence FROM go UNION ALL SELECT question_id, 1, CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END, 'boolean', l[1:1] FROM go),
       pr AS (SELECT question_id, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE l[1] || ' the end' END AS pa, l AS pe FROM go WHERE doc_id % 10 <> 9),
       jo AS (SELECT gd.*, pr.pa, pr.pe, pr.question_id IS NULL AS missing, {_B.format(norm_sql("gd.answer"))} AS gt, {_B.format(norm_sql("coalesce(pr.pa, '')"))} AS pt FROM gd LEFT JOIN pr USING (question_id)),
       ov AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda w: least(len(list_filter(pt, lambda x: x = w)), len(list_filter(gt, lambda x: x = w))))), 0) AS same, len(list_intersect(coalesce(pe, []), evidence)) AS es FROM jo),
       f1 AS (SELECT question_id, n, type, missing, CASE WHEN missing OR same = 0 THEN 0.0 ELSE 2.0 * same / (len(pt) + len(gt)) END AS a, CASE WHEN missing OR es = 0 THEN 0.0 ELSE 2.0 * es / (len(pe) + len(evidence)) END AS e FROM ov),
       be AS (SELECT question_id, max(a) AS a, arg_max(type, a * 10 - n) AS type, max(e) AS e, bool_or(missing) AS missing FROM f1 GROUP BY ALL)"""


@query(f"WITH {SCORES} SELECT question_id, round(a, 6) AS answer_f1, type, round(e, 6) AS evidence_f1, missing FROM be")
def qa_best_scores(t: Tables) -> DataFrame:
    s = ev.best_scores(_gold(t), _predictions(t))
    return s.withColumns({"answer_f1": F.round("answer_f1", 6), "evidence_f1": F.round("evidence_f1", 6)}).select("question_id", "answer_f1", "type", "evidence_f1", "missing")


@query(f"""WITH {SCORES} SELECT round(avg(a), 6) AS answer_f1, round(coalesce(avg(a) FILTER (type = 'extractive'), 0), 6) AS answer_f1_extractive, round(coalesce(avg(a) FILTER (type = 'boolean'), 0), 6) AS answer_f1_boolean,
       round(avg(e), 6) AS evidence_f1, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM be""")
def qa_run_metrics(t: Tables) -> DataFrame:
    m = ev.run_metrics(ev.best_scores(_gold(t), _predictions(t)))
    return m.select(*[F.round(c, 6).alias(c) for c in ("answer_f1", "answer_f1_extractive", "answer_f1_boolean", "evidence_f1")], "missing")


@query(f"""WITH {SCORES} SELECT count(*) AS questions, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(avg(a), 6) AS answer_f1 FROM be WHERE question_id IN (SELECT question_id FROM pr)""")
def qa_subset_metrics(t: Tables) -> DataFrame:
    p = _predictions(t)
    s = ev.best_scores(_gold(t).join(p.select("question_id"), "question_id", "left_semi"), p)
    return s.agg(F.count("*").alias("questions"), F.sum(F.col("missing").cast("long")).alias("missing"), F.round(F.avg("answer_f1"), 6).alias("answer_f1"))


def _papers(t: Tables) -> DataFrame:
    return t.documents.selectExpr(
        "concat('p', doc_id) as id",
        "substring(text, 1, 30) as title",
        "array(named_struct('section_name', 'Intro', 'paragraphs', split(text, '\\n')), named_struct('section_name', 'End', 'paragraphs', array('short', text))) as full_text",
        """array(named_struct('question', 'What is it?', 'question_id', concat('q', doc_id), 'answers', array(named_struct('answer', named_struct('unanswerable', doc_id % 5 = 0, 'extractive_spans', if(doc_id % 5 = 1, array('a', cast(doc_id as string)), cast(array() as array<string>)), 'yes_no', if(doc_id % 5 = 2, true, if(doc_id % 5 = 3, false, null)), 'free_form_answer', if(doc_id % 5 = 4, 'free', ''), 'evidence', array('FLOAT SELECTED: x', 'line'), 'highlighted_evidence', array('h')), 'annotation_id', 'x', 'worker_id', 'w')))) as qas""",
        "array(named_struct('caption', concat('A caption of length over twenty ', doc_id), 'file', 'fig1.png'), named_struct('caption', 'too short', 'file', 'tab1.png')) as figures_and_tables",
    )


@query("""SELECT 'p' || doc_id AS paper_id, 'q' || doc_id AS question_id, 0 AS n, CASE doc_id % 5 WHEN 0 THEN 'Unanswerable' WHEN 1 THEN 'a, ' || doc_id WHEN 2 THEN 'Yes' WHEN 3 THEN 'No' ELSE 'free' END AS answer, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'extractive' WHEN 4 THEN 'abstractive' ELSE 'boolean' END AS type, 'line' AS evidence FROM documents""")
def gold_answers(t: Tables) -> DataFrame:
    return ev.gold_answers(_papers(t), text_only=True).select("paper_id", "question_id", "n", "answer", "type", F.array_join("evidence", "|").alias("evidence"))


@query("""SELECT 'q' || doc_id AS question_id, CASE doc_id % 5 WHEN 0 THEN 'null' WHEN 2 THEN 'yes_no' WHEN 3 THEN 'yes_no' ELSE 'free_text' END AS type, CASE doc_id % 5 WHEN 1 THEN 'a, ' || doc_id WHEN 2 THEN 'Yes' WHEN 3 THEN 'No' WHEN 4 THEN 'free' END AS answer FROM documents""")
def question_flatten(t: Tables) -> DataFrame:
    return ev.flatten_questions(_papers(t)).select("question_id", "type", "answer")


@query(r"""WITH p AS (SELECT doc_id, 0 AS s, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents UNION ALL SELECT doc_id, 1, text, 1 FROM documents)
       SELECT 'p' || doc_id AS paper_id, s AS section_index, i AS paragraph_index, md5(x) AS digest FROM p WHERE length(regexp_replace(x, '^\s+|\s+$', '', 'g')) >= 50""")
def paragraph_nodes(t: Tables) -> DataFrame:
    return ev.paragraph_nodes(_papers(t)).select("paper_id", F.col("section_index").cast("long").alias("section_index"), F.col("paragraph_index").cast("long").alias("paragraph_index"), F.md5("text").alias("digest"))


@query("SELECT 'p' || doc_id AS paper_id, 0 AS figure_index, 'Figure: A caption of length over twenty ' || doc_id AS text FROM documents")
def caption_nodes(t: Tables) -> DataFrame:
    return ev.caption_nodes(_papers(t)).select("paper_id", "figure_index", "text")


@query("""SELECT count(*) AS papers, count(*) AS questions, CAST(sum(len(string_split(text, chr(10))) + 2) AS BIGINT) AS paragraphs, round(1.0, 6)::DOUBLE AS questions_per_paper, round(sum(len(string_split(text, chr(10))) + 2) / count(*), 6)::DOUBLE AS paragraphs_per_paper FROM documents""")
def dataset_stats(t: Tables) -> DataFrame:
    s = ev.dataset_stats(_papers(t))
    return s.withColumns({c: F.round(c, 6) for c in ("questions_per_paper", "paragraphs_per_paper")})


_METRICS = "SELECT event_type, unnest(['faithfulness', 'relevancy']) AS metric, unnest([CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 100 END, value / 50]) AS v FROM events"


def _results(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100).alias("faithfulness"), (F.col("value") / 50).alias("relevancy"), F.col("props").alias("question"), F.col("event_type").alias("answer"))


_SUM = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, CASE WHEN avg(v) IS NULL THEN 'invalid' WHEN avg(v) >= 0.7 THEN 'good' WHEN avg(v) >= 0.5 THEN 'fair' ELSE 'poor' END AS grade"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max")})


@query(f"SELECT metric, {_SUM} FROM ({_METRICS}) GROUP BY ALL")
def metric_summary(t: Tables) -> DataFrame:
    return _rounded(ev.metric_summary(_results(t), ["faithfulness", "relevancy"]))


@query(f"SELECT metric, event_type, {_SUM} FROM ({_METRICS}) GROUP BY metric, event_type")
def metric_summary_by_type(t: Tables) -> DataFrame:
    return _rounded(ev.metric_summary(_results(t), ["faithfulness", "relevancy"], "event_type"))


@query("SELECT substring(props, 1, 80) AS question, substring(event_type, 1, 60) AS answer, round(value / 100, 6) AS faithfulness FROM events WHERE event_id % 17 <> 0 AND value / 100 < 0.5 ORDER BY value / 100, props LIMIT 10")
def weak_samples(t: Tables) -> DataFrame:
    # the SQL leaves rows of equal value and props open; they are taken as they stand
    return ev.weak_samples(_results(t).where("event_id is not null"), then="event_id").withColumn("faithfulness", F.round("faithfulness", 6))


def _pick(x: str, pattern: str) -> str:
    """SQL: the distinct words of x that match the pattern."""
    return rf"list_distinct(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{pattern}')))"


_KW, _NUM = "[a-z]{4,}", "[0-9]+"


@query(f"""{GRADE.replace("WITH", "WITH RECURSIVE", 1)}, kq AS (SELECT query_id, {_pick("lower(text)", _KW)} AS kw, {_pick("text", _NUM)} AS nums FROM q),
       ss AS (SELECT query_id, rank, {SENTENCES.format("text", ".!?", chr(92) + "s+")} AS p FROM h), se AS (SELECT query_id, rank, unnest(range(len(p))) AS pos, unnest(p) AS sentence FROM ss),
       pt AS (SELECT query_id, rank, pos, sentence, 15 * len(list_intersect({_pick("sentence", _NUM)}, nums)) + 10 * len(list_intersect({_pick("lower(sentence)", _KW)}, kw)) AS points FROM se JOIN kq USING (query_id)),
       two AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY points DESC, pos) AS i FROM pt WHERE points > 0 QUALIFY i <= 2),
       al AS (SELECT query_id, sentence, row_number() OVER (PARTITION BY query_id ORDER BY rank, i) AS i FROM two),
       fo AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS got, 0::BIGINT AS n FROM (SELECT DISTINCT query_id FROM al)
              UNION ALL SELECT query_id, al.i, CASE WHEN ok THEN list_append(got, sentence) ELSE got END, CASE WHEN ok THEN n + length(sentence) ELSE n END
              FROM (SELECT fo.query_id, al.i, got, n, sentence, n + length(sentence) <= 500 AND NOT list_contains(list_transform(got, lambda o: substring(o, 1, 50)), substring(sentence, 1, 50)) AS ok FROM fo JOIN al ON al.query_id = fo.query_id AND al.i = fo.i + 1) al)
       SELECT query_id, array_to_string(arg_max(got, i), '|') AS spans FROM fo GROUP BY query_id""")
def evidence_sentences(t: Tables) -> DataFrame:
    from lectern.plans.queries_retrieval import _hits, benchmark_queries

    return ev.evidence_sentences(_hits(t), benchmark_queries(t)).select("query_id", F.array_join("spans", "|").alias("spans"))


#: Spans of 250 characters around clusters of hits, moved to word ends; a span that starts within 50 of a kept one goes.
_POSITIONS = r""", ks AS (SELECT h.query_id, h.rank, h.text, lower(h.text) AS low, unnest(list_distinct(list_concat(regexp_extract_all(lower(q.text), '[\d,.]*\d'), list_filter(regexp_extract_all(lower(q.text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}'))))) AS k FROM h JOIN q USING (query_id)),
       sp AS (SELECT query_id, rank, text, k, unnest(string_split(low, k)) AS part, unnest(range(len(string_split(low, k)))) AS i, len(string_split(low, k)) AS many FROM ks),
       oc AS (SELECT query_id, rank, text, sum(length(part)) OVER (PARTITION BY query_id, rank, k ORDER BY i) + i * length(k) AS a, length(k) AS w, i, many FROM sp),
       hi AS (SELECT DISTINCT query_id, rank, text, a::BIGINT AS a, (a + w)::BIGINT AS b FROM oc WHERE i < many - 1),
       fl AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY query_id, rank ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 50 THEN 0 ELSE 1 END AS new FROM hi),
       cl AS (SELECT query_id, rank, text, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY query_id, rank ORDER BY a, b) AS c FROM fl) GROUP BY query_id, rank, text, c),
       wi AS (SELECT query_id, rank, text, a, length(text) AS n, greatest(0, a - greatest(0, 250 - (b - a)) // 2) AS lo, least(length(text), b + greatest(0, 250 - (b - a)) - greatest(0, 250 - (b - a)) // 2) AS hi FROM cl),
       w2 AS (SELECT query_id, rank, text, a, n, greatest(length(regexp_extract(substring(text, 1, lo::INT), '^(.*\s)', 1, 's')), a - 300, 0) AS lo, least(hi, lo + 300) AS hi FROM wi),
       w3 AS (SELECT query_id, rank, text, a, n, lo, least(hi + length(regexp_extract(substring(text, hi::INT + 1), '^\S*', 0)), greatest(hi, lo + 350)) AS hi FROM w2),
       ga AS (SELECT query_id, rank, text, list({'out': []::STRUCT(lo BIGINT, hi BIGINT)[], 'lo': lo::BIGINT, 'hi': hi::BIGINT} ORDER BY a) AS g FROM w3 WHERE hi - lo >= least(80, n) GROUP BY ALL),
       ke AS (SELECT query_id, rank, text, list_reduce(list_prepend({'out': []::STRUCT(lo BIGINT, hi BIGINT)[], 'lo': 0::BIGINT, 'hi': 0::BIGINT}, g), lambda s, x: {'out': CASE WHEN len(list_filter(s.out, lambda o: abs(x.lo - o.lo) < 50)) > 0 THEN s.out ELSE list_append(s.out, {'lo': x.lo, 'hi': x.hi}) END, 'lo': 0::BIGINT, 'hi': 0::BIGINT}).out[:5] AS o FROM ga),
       un AS (SELECT query_id, rank, u.lo AS "begin", u.hi AS "end", substring(text, (u.lo + 1)::INT, (u.hi - u.lo)::INT) AS span FROM (SELECT query_id, rank, text, unnest(o) AS u FROM ke)),
       bu AS (SELECT *, sum(length(span)) OVER w AS total, count(*) OVER w AS n FROM un WINDOW w AS (PARTITION BY query_id ORDER BY rank, "begin" ROWS UNBOUNDED PRECEDING))
       SELECT query_id, rank, "begin", "end", span FROM bu WHERE total <= 500 AND n <= 5"""


@query(GRADE + _POSITIONS)
def evidence_positions(t: Tables) -> DataFrame:
    from lectern.plans.queries_retrieval import _hits, benchmark_queries

    return ev.evidence_positions(_hits(t), benchmark_queries(t))


_BOX = "CAST(l_orderkey % 10 AS DOUBLE) AS x0, CAST(l_partkey % 10 AS DOUBLE) AS y0, CAST(l_orderkey % 10 + l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 10 + l_quantity AS DOUBLE) AS y1"


def _boxes(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey as doc_id", "cast(l_suppkey % 2 as int) as page", "l_linenumber as idx", "named_struct('x0', cast(l_orderkey % 10 as double), 'y0', cast(l_partkey % 10 as double), 'x1', cast(l_orderkey % 10 + l_quantity as double), 'y1', cast(l_partkey % 10 + l_quantity as double)) as bbox")


@query(f"""WITH b AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INTEGER) AS page, l_linenumber AS idx, {_BOX} FROM lineitem),
       j AS (SELECT a.doc_id, a.page, a.idx, b.idx AS idx2, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
             FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx < b.idx)
       SELECT doc_id, page, idx, idx2, round(i / (s - i), 6) AS iou FROM j WHERE i / (s - i) > 0.5""")
def box_overlaps(t: Tables) -> DataFrame:
    return layout.overlaps(_boxes(t)).withColumn("iou", F.round("iou", 6))


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INTEGER) AS page, CAST(l_linenumber AS INTEGER) AS idx, {_BOX} FROM lineitem),
       o AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY doc_id, page ORDER BY (x1 - x0) * (y1 - y0) DESC, idx, x0, y0, x1, y1) AS i FROM b),
       f AS (SELECT doc_id, page, i, [{{'idx': idx, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area}}] AS kept FROM o WHERE i = 1
             UNION ALL SELECT o.doc_id, o.page, o.i, CASE WHEN len(list_filter(f.kept, lambda k: greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0.0) * greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0.0)
                    > 0.5 * (k.area + o.area - greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0.0) * greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0.0)))) > 0 THEN f.kept
                  ELSE list_append(f.kept, {{'idx': o.idx, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'area': o.area}}) END
             FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.i = f.i + 1)
       SELECT doc_id, page, k.idx AS idx FROM (SELECT doc_id, page, unnest(arg_max(kept, i)) AS k FROM f GROUP BY doc_id, page)""")
def box_suppression(t: Tables) -> DataFrame:
    return layout.suppress(_boxes(t).withColumn("idx", F.col("idx").cast("int")))


@query(f"SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INTEGER) AS page, {_BOX} FROM lineitem) GROUP BY ALL")
def merged_boxes(t: Tables) -> DataFrame:
    return layout.merged_box(_boxes(t), ["doc_id", "page"]).select("doc_id", "page", "bbox.*")


@query("SELECT l_orderkey AS doc_id, string_agg(CAST(l_partkey AS VARCHAR) || 'x', ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR) || 'x') AS lines FROM lineitem WHERE NOT (l_linenumber % 3 = 0 AND l_suppkey % 2 = 0) GROUP BY ALL")
def margin_line_numbers(t: Tables) -> DataFrame:
    lines = t.lineitem.selectExpr("l_orderkey as doc_id", "l_linenumber as line_no", "100.0D as page_width", "if(l_suppkey % 2 = 0, 2.0D, 30.0D) as x0", "50.0D as x1", "if(l_linenumber % 3 = 0, cast(l_linenumber as string), concat(l_partkey, 'x')) as text", "concat(l_partkey, 'x') as shown")
    return layout.body_lines(lines).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "shown"))), lambda x: x["shown"]), ",").alias("lines"))


@query("SELECT l_orderkey AS query_id, l_suppkey || '.png' AS image_path, max(CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 100 WHEN l_partkey % 3 = 0 THEN 95 WHEN l_partkey % 3 = 1 AND l_linenumber <= 3 THEN 80 WHEN l_partkey % 3 = 1 THEN 70 WHEN l_linenumber <= 3 THEN 50 ELSE 30 END) AS priority FROM lineitem GROUP BY ALL")
def image_priority(t: Tables) -> DataFrame:
    s = t.lineitem.selectExpr("l_orderkey as query_id", "l_linenumber as rank", "concat(l_suppkey, '.png') as image_path", "l_partkey % 3 = 0 as is_caption", "l_partkey % 3 = 1 as mentions")
    return layout.image_priority(s).select("query_id", "image_path", "priority")


_CACHE = """WITH RECURSIVE o AS (SELECT user_id || '|' || event_type AS key, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
       f AS (SELECT key, ts, event_id, i, ts AS made, false AS hit FROM o WHERE i = 1
             UNION ALL SELECT o.key, o.ts, o.event_id, o.i, CASE WHEN o.ts - f.made < INTERVAL 24 HOUR THEN f.made ELSE o.ts END, o.ts - f.made < INTERVAL 24 HOUR FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
       SELECT event_id, key, hit FROM f"""


@query(_CACHE)
def ttl_cache(t: Tables) -> DataFrame:
    req = t.events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", "event_id")
    return inc.cache_outcomes(req, 24 * 3600).select("event_id", "key", "hit")


@query("""SELECT event_id, user_id, seen, CAST(floor(seen / 10) AS BIGINT) AS firing FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events) WHERE seen % 10 = 0""")
def threshold_trigger(t: Tables) -> DataFrame:
    return inc.trigger_points(t.events).select("event_id", "user_id", F.col("seen").cast("long").alias("seen"), "firing")


@query(_CACHE)
def ttl_cache_stream(t: Tables) -> DataFrame:
    req = t.events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", "event_id")
    return state.replay(req, lambda s: state.cache_stream(s, 24 * 3600, "1 day")).select("event_id", "key", "hit")


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events)
       SELECT user_id, CAST(ceil(seen / 10) AS BIGINT) AS firing, max_by(event_id, seen) AS event_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seen) AS members
       FROM o GROUP BY user_id, CAST(ceil(seen / 10) AS BIGINT) HAVING count(*) = 10""")
def threshold_stream(t: Tables) -> DataFrame:
    out = state.replay(t.events.select(F.col("user_id").alias("key"), "ts", "event_id"), lambda s: state.threshold_stream(s, 10, "1 day"))
    return out.select(F.col("key").cast("long").alias("user_id"), "firing", "event_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("""WITH c AS (SELECT event_id % 5 AS part, count(*) AS rows FROM events GROUP BY ALL), r AS (SELECT *, CAST(sum(rows) OVER (ORDER BY part) AS BIGINT) AS total FROM c)
       SELECT total, rows FROM r WHERE total // 300 > (total - rows) // 300""")
def autosave_points(t: Tables) -> DataFrame:
    return state.autosaved(t.events.select("event_id"), "event_id % 5", 5, 300)


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def sliding_rate(t: Tables) -> DataFrame:
    return inc.sliding_requests(t.events, "event_type", seconds=3600).select("event_id", "recent")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, count(*) > 96 AS over FROM events GROUP BY ALL""")
def rate_windows(t: Tables) -> DataFrame:
    return inc.rate_windows(t.events, "1 hour").select("start", "requests", "over")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def sessionize(t: Tables) -> DataFrame:
    return inc.sessions(t.events, "user_id")


@query("SELECT user_id || '|' || event_type AS key, max(ts) AS made FROM events GROUP BY ALL ORDER BY max(ts) DESC, key LIMIT 100")
def cache_evictions(t: Tables) -> DataFrame:
    e = t.events.groupBy(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key")).agg(F.max("ts").alias("made"))
    return inc.evictions(e)

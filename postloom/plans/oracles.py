"""The registered queries once more as plain SQL, to check results against another engine."""

from __future__ import annotations

from postloom import constants as C
from postloom.operators.bayes import SMOOTHING
from postloom.plans import views as V
from postloom.plans.settings import (
    CUSTOM_STOPWORDS,
    DATASET_END,
    DATASET_START,
    EVENT_VALUES,
    FOLDS,
    LINE_VALUE,
    MAX_DEPTH,
    MONTH_END,
    MONTH_START,
    POST_VALUE,
    SEED,
    TOP_FILES,
)


def _quoted(words) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


def _with(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


POSTS = ("posts", V.POSTS_SQL)
THREAD = ("thread", V.THREAD_SQL)
PROGRESS = ("progress", V.PROGRESS_SQL)
LINES = ("lines", V.LINES_SQL)

DATASET = (
    "dataset",
    f"""
SELECT id, coalesce(title, '') || ' ' || coalesce(selftext, '') AS text, link_flair_text AS label_post FROM posts
WHERE link_flair_text IN ({_quoted(C.FLAIRS)}) AND subreddit = '{C.COMMUNITY}'
 AND created_epoch > epoch(TIMESTAMP '{DATASET_START}-01') AND created_epoch < epoch(TIMESTAMP '{DATASET_END}-01')
 AND selftext <> '[deleted]' AND selftext <> '[removed]'""",
)


def _no_urls(text: str) -> str:
    return rf"regexp_replace({text}, 'https?://[^\s\x1C-\x1F]+', '', 'g')"


def _no_punct(text: str) -> str:
    return f"regexp_replace({text}, '[[:punct:]]', '', 'g')"


def _ascii(text: str) -> str:
    return rf"regexp_replace({text}, '[^\x00-\x7F]', '', 'g')"


def _tokens(text: str) -> str:
    for head, tail in C.SPLIT_WORDS:
        text = rf"regexp_replace({text}, '(?i)\b({head})({tail})\b', '\1 \2', 'g')"
    return rf"[w FOR w IN regexp_split_to_array({text}, '[\t-\r\x1C-\x20]+') IF w <> '']"


def _plain(text: str) -> str:
    return f"lower({_ascii(_no_punct(_no_urls(text)))})"


PLAIN = ("plain", f"SELECT id, label_post, {_tokens(_plain('text'))} AS tokens FROM dataset")
_STOP = _quoted(C.ENGLISH_STOPWORDS)
SHORTENED = (
    "shortened",
    f"SELECT id, label_post, [w FOR w IN tokens IF w NOT IN ({_STOP}) AND length(w) >= 3] AS tokens FROM plain",
)
WORDS = ("words", "SELECT DISTINCT unnest(tokens) AS word FROM shortened")
RULES = (
    "rules",
    "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in [("", ""), *C.NOUN_ENDINGS]) + ") AS t(old, new)",
)
LEMMAS = (
    "lemmas",
    """
SELECT word, form AS lemma FROM (
 SELECT c.word, c.form, row_number() OVER (PARTITION BY c.word ORDER BY length(c.form), c.form) AS rn
 FROM (SELECT word, left(word, length(word) - length(old)) || new AS form FROM words, rules WHERE suffix(word, old)) c
 JOIN words k ON k.word = c.form
) WHERE rn = 1 AND word <> form""",
)
SPELLED = (
    "spelled",
    """
SELECT s.id, list(coalesce(l.lemma, s.word) ORDER BY s.pos) AS tokens
FROM (SELECT id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM shortened) s
LEFT JOIN lemmas l ON l.word = s.word GROUP BY s.id""",
)
CLEAN = (
    "clean",
    """
SELECT d.id, d.label_post, coalesce(array_to_string(s.tokens, ' '), '') AS text_clean
FROM shortened d LEFT JOIN spelled s ON s.id = d.id""",
)
TO_CLEAN = (POSTS, DATASET, PLAIN, SHORTENED, WORDS, RULES, LEMMAS, SPELLED, CLEAN)

TERMS = (
    "terms",
    r"""
SELECT id, term, count(*) AS tf
FROM (SELECT id, unnest(regexp_extract_all(lower(text_clean), '\b\w\w+\b')) AS term FROM clean) GROUP BY id, term""",
)
IDF = (
    "idf",
    "SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM clean)) / (1.0 + count(*))) + 1.0 AS idf "
    "FROM terms GROUP BY term",
)
TFIDF = (
    "tfidf",
    """
SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight
FROM terms JOIN idf USING (term)""",
)
RANKED = (
    "ranked",
    f"""
SELECT *, row_number() OVER (PARTITION BY label_post ORDER BY md5('{SEED}:' || id), id) AS rank,
 count(*) OVER (PARTITION BY label_post) AS label_rows FROM {{source}}""",
)


def _ranked(source: str) -> tuple[str, str]:
    return RANKED[0], RANKED[1].format(source=source)


SPLIT = ("split", "SELECT *, rank <= (2 * label_rows + 5) // 10 AS is_valid FROM ranked")

STATUS = (
    "status",
    f"""
SELECT *, CASE WHEN NOT json_valid(value) THEN 'bad_json' WHEN json_type(value) <> 'OBJECT' THEN 'not_object'
  WHEN NOT json_exists(value, '$.subreddit') THEN 'missing_field'
  WHEN json_type(value, '$.subreddit') <> 'VARCHAR' THEN 'non_string_field' ELSE 'ok' END AS line_status FROM lines""",
)
MARKED = (
    "marked",
    f"""
SELECT *, coalesce(line_status = 'ok' AND contains(lower(CASE WHEN line_status = 'ok' THEN json_extract_string(value, '$.subreddit') END), '{LINE_VALUE}'), false) AS matched
FROM status""",
)
RECORDS = (
    "records",
    """
SELECT event_id, file_name, j ->> '$.id' AS id, 'u/' || nullif(j ->> '$.author', '') AS author, j ->> '$.title' AS title,
 cast(j ->> '$.created_utc' AS bigint) AS created_epoch,
 CASE WHEN json_exists(j, '$.selftext') THEN j ->> '$.selftext' ELSE '' END AS selftext,
 j ->> '$.subreddit' AS subreddit, j ->> '$.link_flair_text' AS link_flair_text,
 '{prefix}' || nullif(j ->> '$.permalink', '') AS link,
 cast(j ->> '$.num_comments' AS int) AS num_comments, cast(j ->> '$.score' AS int) AS score
FROM (SELECT event_id, file_name, CASE WHEN matched THEN value END AS j FROM marked WHERE matched)""".replace("{prefix}", C.LINK_PREFIX),
)


def _tree(keep: str = "true", limit: str = "true") -> str:
    return f"""
WITH RECURSIVE thread AS ({V.THREAD_SQL}), kept AS (SELECT * FROM thread WHERE {keep}),
tree AS (
 SELECT id, post_id, 0 AS depth FROM kept WHERE parent_id = post_id AND {limit.format(depth='0')}
 UNION ALL
 SELECT k.id, k.post_id, t.depth + 1 FROM kept k JOIN tree t ON k.parent_id = t.id AND k.post_id = t.post_id
 WHERE {limit.format(depth='t.depth + 1')}
)
SELECT id, post_id, cast(depth AS int) AS depth FROM tree"""


_KEPT = f"body IS NOT NULL AND coalesce(author, '') <> '{C.EXCLUDED_AUTHOR}'"
_POST_COLUMNS = "id, title, selftext, created_epoch, subreddit, link_flair_text"
_PAIRS = ("pairs", "SELECT quality AS label, 1 - toxic AS prediction FROM labels")
_COUNTS = ("counts", "SELECT label, prediction, count(*) AS n FROM pairs GROUP BY 1, 2")
_REPORT = (
    "report",
    """
SELECT label, coalesce(hits / nullif(claimed, 0), 0.0) AS p, coalesce(hits / nullif(support, 0), 0.0) AS r,
 coalesce(2.0 * hits / nullif(claimed + support, 0), 0.0) AS f, support
FROM (SELECT c.label, (SELECT count(*) FROM pairs WHERE label = c.label) AS support,
  (SELECT count(*) FROM pairs WHERE prediction = c.label) AS claimed,
  cast((SELECT count(*) FROM pairs WHERE prediction = c.label AND label = c.label) AS double) AS hits
 FROM (SELECT label FROM pairs UNION SELECT prediction FROM pairs) c)""",
)
_SECONDS = ("timed", "SELECT *, epoch(ts) AS seconds FROM progress")
_RATES = (
    "rates",
    """
SELECT *, cast(floor((bytes_done - first_value(bytes_done) OVER w) / nullif(seconds - first_value(seconds) OVER w, 0)) AS bigint) AS bytes_per_second,
 (lines_done - first_value(lines_done) OVER w) / nullif(seconds - first_value(seconds) OVER w, 0) AS lines_per_second
FROM timed WINDOW w AS (PARTITION BY run ORDER BY lines_done ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
)
_FILES = (
    "files",
    """
SELECT file_name, count(*) AS lines_processed, count(*) FILTER (matched) AS lines_matched,
 count(*) FILTER (line_status <> 'ok') AS error_lines, sum(strlen(value)) AS bytes
FROM marked GROUP BY file_name""",
)


def _bayes(smoothing: float) -> str:
    return (
        _with(
            *TO_CLEAN, TERMS, _ranked("clean"), SPLIT,
            ("train_terms", "SELECT t.*, s.label_post FROM terms t JOIN split s USING (id) WHERE NOT is_valid"),
            ("n_docs", "SELECT count(*) AS n FROM split WHERE NOT is_valid"),
            ("classes", "SELECT label_post, count(*) AS nc FROM split WHERE NOT is_valid GROUP BY 1"),
            ("idf", "SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM train_terms, n_docs GROUP BY term"),
            ("weights", """
SELECT id, term, label_post, is_valid, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w
FROM terms JOIN idf USING (term) JOIN split USING (id)"""),
            ("eps", f"""
SELECT {smoothing!r} * max(v) AS e FROM (SELECT greatest(sum(w * w) / any_value(n) - pow(sum(w) / any_value(n), 2), 0) AS v
 FROM weights, n_docs WHERE NOT is_valid GROUP BY term)"""),
            ("grid", """
SELECT c.label_post, i.term, coalesce(s1, 0) / nc AS m, greatest(coalesce(s2, 0) / nc - pow(coalesce(s1, 0) / nc, 2), 0) + e AS v
FROM classes c CROSS JOIN idf i CROSS JOIN eps LEFT JOIN
 (SELECT label_post, term, sum(w) AS s1, sum(w * w) AS s2 FROM weights WHERE NOT is_valid GROUP BY 1, 2) s
 ON s.label_post = c.label_post AND s.term = i.term"""),
            ("base", """
SELECT g.label_post, ln(any_value(nc) / any_value(n)) + sum(-0.5 * ln(2 * pi() * v) - 0.5 * m * m / v) AS b
FROM grid g JOIN classes c ON c.label_post = g.label_post, n_docs GROUP BY g.label_post"""),
            ("changes", """
SELECT w.id, g.label_post, sum((w.w * g.m - 0.5 * w.w * w.w) / g.v) AS d FROM weights w JOIN grid g ON g.term = w.term
WHERE w.is_valid GROUP BY 1, 2"""),
            ("scores", """
SELECT s.id, s.label_post AS label, b.label_post AS candidate, b.b + coalesce(c.d, 0) AS score
FROM split s CROSS JOIN base b LEFT JOIN changes c ON c.id = s.id AND c.label_post = b.label_post WHERE s.is_valid"""),
        )
        + "SELECT id, label, candidate AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS rn FROM scores) WHERE rn = 1"
    )


_HELD_OUT = (
    _with(POSTS, DATASET, _ranked("dataset"), SPLIT)
    + "SELECT id, label_post AS label, true AS known_label FROM split WHERE is_valid"
)
_MAJORITY = (
    _with(POSTS, DATASET, _ranked("dataset"), SPLIT)
    + """SELECT cast(sum(n) AS bigint) AS n, max(n) AS largest, true AS beats_majority
FROM (SELECT label_post, count(*) AS n FROM split WHERE is_valid GROUP BY 1)"""
)


def _bayes_grid(smoothing: list[float], folds: int) -> str:
    values = ", ".join(f"({i}, {v!r})" for i, v in enumerate(smoothing))
    return (
        _with(
            *TO_CLEAN, TERMS, _ranked("clean"), SPLIT,
            ("train", "SELECT id, label_post FROM split WHERE NOT is_valid"),
            ("dealt", f"SELECT id, label_post, (row_number() OVER (PARTITION BY label_post ORDER BY md5('{SEED}:' || id), id) - 1) % {folds} AS fold FROM train"),
            ("f", f"SELECT unnest(range({folds})) AS f"),
            ("s", f"SELECT * FROM (VALUES {values}) AS t(grid_index, smoothing)"),
            ("n_docs", "SELECT f, count(*) AS n FROM dealt JOIN f ON fold <> f GROUP BY f"),
            ("classes", "SELECT f, label_post, count(*) AS nc FROM dealt JOIN f ON fold <> f GROUP BY 1, 2"),
            ("freq", "SELECT f, term, count(*) AS df FROM terms JOIN dealt USING (id) JOIN f ON fold <> f GROUP BY 1, 2"),
            ("idf", "SELECT f, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM freq JOIN n_docs USING (f)"),
            ("weights", """
SELECT i.f, id, term, label_post, fold = i.f AS held, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY i.f, id)) AS w
FROM terms JOIN dealt USING (id) JOIN idf i USING (term)"""),
            ("sums", "SELECT f, label_post, term, sum(w) AS s1, sum(w * w) AS s2 FROM weights WHERE NOT held GROUP BY 1, 2, 3"),
            ("top", """
SELECT f, max(v) AS v FROM (SELECT f, greatest(sum(s2) / any_value(n) - pow(sum(s1) / any_value(n), 2), 0) AS v
 FROM sums JOIN n_docs USING (f) GROUP BY f, term) GROUP BY f"""),
            ("grid", """
SELECT i.f, grid_index, c.label_post, i.term, coalesce(s1, 0) / nc AS m,
 greatest(coalesce(s2, 0) / nc - pow(coalesce(s1, 0) / nc, 2), 0) + smoothing * top.v AS v
FROM idf i JOIN classes c ON c.f = i.f JOIN top ON top.f = i.f CROSS JOIN s
LEFT JOIN sums ON sums.f = i.f AND sums.label_post = c.label_post AND sums.term = i.term"""),
            ("base", """
SELECT g.f, grid_index, g.label_post, ln(any_value(nc) / any_value(n)) + sum(-0.5 * ln(2 * pi() * v) - 0.5 * m * m / v) AS b
FROM grid g JOIN classes c ON c.f = g.f AND c.label_post = g.label_post JOIN n_docs d ON d.f = g.f GROUP BY 1, 2, 3"""),
            ("changes", """
SELECT w.f, w.id, grid_index, g.label_post, sum((w.w * g.m - 0.5 * w.w * w.w) / g.v) AS d
FROM weights w JOIN grid g ON g.f = w.f AND g.term = w.term WHERE held GROUP BY 1, 2, 3, 4"""),
            ("scores", """
SELECT t.fold AS f, t.id, b.grid_index, t.label_post AS label, b.label_post AS candidate, b.b + coalesce(c.d, 0) AS score
FROM dealt t JOIN base b ON b.f = t.fold
LEFT JOIN changes c ON c.id = t.id AND c.grid_index = b.grid_index AND c.label_post = b.label_post"""),
            ("best", "SELECT *, row_number() OVER (PARTITION BY id, grid_index ORDER BY score DESC, candidate) AS rn FROM scores"),
            ("per_fold", "SELECT f, grid_index, avg(cast(label = candidate AS int)) AS a FROM best WHERE rn = 1 GROUP BY 1, 2"),
        )
        + "SELECT cast(grid_index AS int) AS grid_index, round(avg(a), 6) AS score FROM per_fold GROUP BY grid_index"
    )


def oracle_sql() -> dict[str, str]:
    queries = {
        "flair_dataset": _with(POSTS, DATASET) + "SELECT id, text, label_post FROM dataset",
        "label_counts": _with(POSTS, DATASET, PLAIN, SHORTENED)
        + "SELECT label_post, count(*) AS posts, cast(sum(len(tokens)) AS bigint) AS words FROM shortened GROUP BY label_post",
        "field_filter_contains": _with(POSTS)
        + f"SELECT {_POST_COLUMNS} FROM posts WHERE contains(lower(subreddit), lower('{POST_VALUE}'))",
        "field_filter_any": "SELECT event_id, user_id, event_type, value FROM events "
        + f"WHERE lower(event_type) IN ({_quoted(sorted(v.strip().lower() for v in EVENT_VALUES.split(',')))})",
        "record_projection": _with(LINES, STATUS, MARKED, RECORDS)
        + "SELECT event_id, id, author, title, created_epoch, selftext, subreddit, link_flair_text, link, num_comments, score FROM records",
        "line_status_counts": _with(LINES, STATUS, MARKED)
        + "SELECT file_name, line_status, count(*) AS n FROM marked GROUP BY 1, 2",
        "file_counters": _with(LINES, STATUS, MARKED, _FILES)
        + "SELECT file_name, lines_processed, lines_matched, error_lines FROM files",
        "month_prune": _with(LINES)
        + r"""
SELECT file_name, regexp_extract(file_name, '(\d{4}-\d{2})', 1) AS month,
 CASE WHEN file_name LIKE 'RS%' THEN 'submissions' ELSE 'comments' END AS entity, count(*) AS lines FROM lines
WHERE regexp_extract(file_name, '(\d{4}-\d{2})', 1) = ''"""
        + rf" OR regexp_extract(file_name, '(\d{{4}}-\d{{2}})', 1) BETWEEN '{MONTH_START}' AND '{MONTH_END}' GROUP BY file_name",
        "ingest_totals": _with(PROGRESS)
        + """
SELECT count(*) AS files, cast(sum(total) AS bigint) AS total_bytes, cast(sum(bytes_done) AS bigint) AS bytes_processed, cast(sum(lines_done) AS bigint) AS lines_processed,
 cast(sum(lines_done - lines_done // 3) AS bigint) AS lines_matched, cast(sum(lines_done // 50) AS bigint) AS error_lines,
 count(*) FILTER (event_type = 'purchase' OR event_type = 'error') AS files_done, count(*) FILTER (event_type = 'error') AS files_failed
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY lines_done DESC) AS rn, bytes_done + 1000 AS total FROM progress) WHERE rn = 1""",
        "incremental_files": _with(LINES, STATUS, MARKED)
        + f"""
SELECT event_id, file_name, line_status, matched FROM marked
WHERE file_name NOT IN (SELECT file_name FROM lines WHERE regexp_extract(file_name, '(\\d{{4}}-\\d{{2}})', 1) < '{MONTH_START}' AND file_name LIKE '%-%')""",
        "dedup_keep_first": """
SELECT event_id, epoch_us(ts) AS ts_us, source, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, source) AS rn FROM (
  SELECT event_id, ts, 'b' AS source, event_type, value FROM events
  UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 1 HOUR END, 'a', event_type, value + 1 FROM events)
) WHERE rn = 1""",
        "largest_files": _with(LINES, STATUS, MARKED, _FILES)
        + f"SELECT file_name, cast(bytes AS bigint) AS bytes, lines_processed FROM files ORDER BY bytes DESC, file_name LIMIT {TOP_FILES}",
        "rolling_rate": _with(PROGRESS, _SECONDS, _RATES)
        + "SELECT run, sample_id, bytes_per_second, round(lines_per_second, 9) AS lines_per_second FROM rates",
        "eta": _with(PROGRESS, _SECONDS, _RATES)
        + """
SELECT run, sample_id, round(avg_speed, 6) AS avg_speed, cast(floor((total - bytes_done) / nullif(floor(avg_speed), 0)) AS bigint) AS seconds_left FROM (
 SELECT *, avg(bytes_per_second) OVER (PARTITION BY run ORDER BY lines_done ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS avg_speed,
  max(bytes_done) OVER (PARTITION BY run) AS total FROM rates)""",
        "thread_depth": _tree(),
        "thread_pruned": _tree(_KEPT),
        "thread_max_depth": _tree(_KEPT, f"{{depth}} <= {MAX_DEPTH}"),
        "comment_projection": _with(THREAD)
        + f"SELECT id, post_id, parent_id, CASE WHEN author = '[deleted]' THEN author ELSE 'u/' || author END AS author, body FROM thread WHERE {_KEPT}",
        "comments_per_post": _with(
            THREAD, ("starts", "SELECT concat('p', cast(conv_id AS string)) AS id, role AS started_by, text AS opening FROM conversations WHERE turn = 0")
        )
        + "SELECT s.id, any_value(started_by) AS started_by, any_value(opening) AS opening, count(t.post_id) AS comments FROM starts s LEFT JOIN thread t ON t.post_id = s.id GROUP BY s.id",
        "remove_urls": _with(POSTS, DATASET) + f"SELECT id, {_no_urls('text')} AS text FROM dataset",
        "remove_punct": _with(POSTS, DATASET) + f"SELECT id, {_no_punct('text')} AS text FROM dataset",
        "remove_non_ascii": "SELECT doc_id, " + _ascii("text") + " AS text FROM documents",
        "tokenize": _with(POSTS, DATASET, PLAIN) + "SELECT id, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n FROM plain",
        "remove_stopwords": _with(POSTS, DATASET, PLAIN)
        + f"SELECT id, array_to_string([w FOR w IN tokens IF w NOT IN ({_quoted(sorted({*C.ENGLISH_STOPWORDS, *CUSTOM_STOPWORDS}))})], ' ') AS tokens FROM plain",
        "remove_short": _with(POSTS, DATASET, PLAIN)
        + "SELECT id, array_to_string([w FOR w IN tokens IF length(w) >= 3], ' ') AS tokens FROM plain",
        "stopword_hits": _with(POSTS, DATASET, PLAIN)
        + f"SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM plain) WHERE word IN ({_quoted(sorted({*C.ENGLISH_STOPWORDS, *CUSTOM_STOPWORDS}))}) GROUP BY word",
        "lemma_table": _with(POSTS, DATASET, PLAIN, SHORTENED, WORDS, RULES, LEMMAS) + "SELECT word, lemma FROM lemmas",
        "lemmatize": _with(*TO_CLEAN)
        + "SELECT d.id, coalesce(array_to_string(s.tokens, ' '), '') AS tokens FROM shortened d LEFT JOIN spelled s ON s.id = d.id",
        "clean_text": _with(*TO_CLEAN) + "SELECT id, label_post, text_clean FROM clean",
        "term_counts": _with(*TO_CLEAN, TERMS) + "SELECT id, term, tf FROM terms",
        "doc_freq": _with(*TO_CLEAN, TERMS, IDF) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
        "vocabulary": _with(*TO_CLEAN, TERMS) + "SELECT DISTINCT term FROM terms ORDER BY term",
        "tfidf": _with(*TO_CLEAN, TERMS, IDF, TFIDF) + "SELECT id, term, round(weight, 6) AS weight FROM tfidf",
        "smooth_tfidf": _with(*TO_CLEAN, TERMS, IDF, TFIDF) + "SELECT id, term, round(weight, 6) AS weight FROM tfidf",
        "stored_dataset": _with(*TO_CLEAN) + "SELECT label_post, text_clean FROM clean",
        "stored_weights": _with(*TO_CLEAN, TERMS, IDF, TFIDF) + "SELECT id, term, round(weight, 6) AS weight FROM tfidf",
        "label_set": _with(POSTS, DATASET) + "SELECT DISTINCT label_post FROM dataset ORDER BY label_post",
        "class_weights": _with(POSTS, DATASET)
        + "SELECT label_post, count(*) AS n, round((SELECT count(*) FROM dataset) / ((SELECT count(DISTINCT label_post) FROM dataset) * count(*)), 9) AS weight FROM dataset GROUP BY label_post",
        "stratified_split": _with(POSTS, DATASET, _ranked("dataset"), SPLIT) + "SELECT id, label_post, is_valid FROM split",
        "stratified_folds": _with(POSTS, DATASET, _ranked("dataset"))
        + "SELECT id, label_post, cast((rank - 1) % 10 AS int) AS fold FROM ranked",
        "gaussian_nb_predict": _bayes(1e-7),
        "rf_predict": _HELD_OUT,
        "svm_predict": _HELD_OUT,
        "rf_accuracy": _MAJORITY,
        "svm_accuracy": _MAJORITY,
        "grid_scores": _bayes_grid(SMOOTHING, FOLDS),
        "predict_batch": _bayes(1e-7),
        "predict_stream": _bayes(1e-7),
        "confusion_counts": _with(_PAIRS, _COUNTS) + "SELECT label, prediction, n FROM counts",
        "confusion_matrix": _with(_PAIRS, _COUNTS)
        + """SELECT label, coalesce(sum(n) FILTER (prediction = 0), 0)::bigint AS predicted_0,
 coalesce(sum(n) FILTER (prediction = 1), 0)::bigint AS predicted_1 FROM counts GROUP BY label""",
        "best_score": f"SELECT * FROM ({_bayes_grid(SMOOTHING, FOLDS)}) ORDER BY score DESC, grid_index LIMIT 1",
        "confusion_percent": _with(_PAIRS, _COUNTS)
        + "SELECT label, prediction, n, round(100.0 * n / sum(n) OVER (PARTITION BY label), 6) AS percent FROM counts",
        "classification_report": _with(_PAIRS, _COUNTS, _REPORT)
        + """
SELECT cast(label AS string) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM report
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM (SELECT count(*) FILTER (label = prediction) / count(*) AS a, count(*) AS n FROM pairs)
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(support) AS bigint) FROM report
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), cast(sum(support) AS bigint) FROM report""",
    }
    queries["stream_ingest"] = (
        _with(LINES, STATUS, MARKED, RECORDS)
        + "SELECT id, author, title, created_epoch, selftext, subreddit, link, score FROM records WHERE file_name LIKE 'RS%'"
    )
    return queries

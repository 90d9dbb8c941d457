"""The registered queries: each reads whole tables of a folder and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import constants as C
from postloom.functions import names
from postloom.functions import text as X
from postloom.functions.stages import SmoothTfidf
from postloom.operators import bayes, dataset, evaluation, joins, lemmas, progress, records, sampling, threads, tfidf
from postloom import schemas
from postloom.plans import settings as S
from postloom.plans import train
from postloom.plans import views as V
from postloom.plans.preprocess import clean_text, preprocess_dataset
from postloom.session import configure, scratch_folder, written
from postloom.sources import dumps, manifest
from postloom.sources.tables import read_committed, read_dataset, read_training_csv, write_dataset, write_weights
from postloom.streaming.ingest import ingest_stream
from postloom.streaming.score import stream_predictions

Query = Callable[[SparkSession, str], DataFrame]


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.flair_dataset(V.posts(spark, sf_dir), S.DATASET_START, S.DATASET_END, keep=("id",))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spread_few_files(_dataset(spark, sf_dir), "id")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.remove_non_ascii(X.remove_punctuation(X.remove_urls(F.col("text"))))
    return _texts(spark, sf_dir).select("id", "label_post", X.tokenize(F.lower(text)).alias("tokens"))


def _shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select(
        "id", "label_post", X.clean_tokens(F.col("text"), C.ENGLISH_STOPWORDS).alias("tokens")
    )


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_text(_texts(spark, sf_dir))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.mark_matches(records.parse_lines(V.lines(spark, sf_dir)), S.LINE_VALUE)


def flair_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir)


def label_counts(spark, sf_dir):
    """Flagship: posts to labelled dataset to cleaned words, counted per label."""
    return _shortened(spark, sf_dir).groupBy("label_post").agg(
        F.count("*").alias("posts"), F.sum(F.size("tokens")).alias("words")
    )


def field_filter_contains(spark, sf_dir):
    posts = V.posts(spark, sf_dir).where(records.matches(F.col("subreddit"), S.POST_VALUE))
    return posts.select("id", "title", "selftext", "created_epoch", "subreddit", "link_flair_text")


def field_filter_any(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").where(records.matches(F.col("event_type"), S.EVENT_VALUES))
    return events.select("event_id", "user_id", "event_type", "value")


def record_projection(spark, sf_dir):
    posts = records.select_posts(_marked(spark, sf_dir).where("matched"), "event_id")
    return posts.select(
        "event_id", "id", "author", "title", F.unix_seconds("created_utc").alias("created_epoch"), "selftext",
        "subreddit", "link_flair_text", "link", "num_comments", "score",
    )


def line_status_counts(spark, sf_dir):
    return _marked(spark, sf_dir).groupBy("file_name", "line_status").agg(F.count("*").alias("n"))


def file_counters(spark, sf_dir):
    return records.line_counters(_marked(spark, sf_dir), "file_name")


def month_prune(spark, sf_dir):
    file_name = F.col("file_name")
    kept = V.lines(spark, sf_dir).where(names.in_months(file_name, S.MONTH_START, S.MONTH_END))
    files = kept.groupBy("file_name").agg(F.count("*").alias("lines"))
    return files.select("file_name", names.month_of(file_name).alias("month"), names.entity_of(file_name).alias("entity"), "lines")


def ingest_totals(spark, sf_dir):
    """Latest progress sample per run, taken as the state of one file, summed over all of them."""
    updates = V.progress(spark, sf_dir).select("run", "lines_done", "bytes_done", "event_type")
    last = records.latest_state(updates, "run", ["lines_done"])
    third, fiftieth = F.floor(F.col("lines_done") / 3), F.floor(F.col("lines_done") / 50)
    files = last.select(
        (F.col("bytes_done") + 1000).alias("file_size"),
        F.col("bytes_done").alias("bytes_processed"),
        F.col("lines_done").alias("lines_processed"),
        (F.col("lines_done") - third).alias("lines_matched"),
        fiftieth.alias("error_lines"),
        (F.col("event_type") == "purchase").alias("complete"),
        F.when(F.col("event_type") == "error", "failed").alias("error_message"),
    )
    return records.run_totals(files)


def incremental_files(spark, sf_dir):
    """Lines of files an earlier run (all months before the start month) has not completed."""
    lines = V.lines(spark, sf_dir)
    month = names.month_of(F.col("file_name"))
    done = lines.where((month != "") & (month < S.MONTH_START)).select(
        F.col("file_name").alias("input_path"), F.lit(True).alias("complete")
    )
    files = lines.select(F.col("file_name").alias("path")).distinct()
    # one row per file on the right; lines of completed files are dropped before they are parsed
    fresh = lines.join(manifest.pending(files, done), F.col("file_name") == F.col("path"), "left_semi")
    marked = records.mark_matches(records.parse_lines(fresh), S.LINE_VALUE)
    return marked.select("event_id", "file_name", "line_status", "matched")


def dedup_keep_first(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    first = events.select("event_id", "ts", F.lit("b").alias("source"), "event_type", "value")
    again = events.select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"),
        F.lit("a").alias("source"),
        "event_type",
        (F.col("value") + 1).alias("value"),
    )
    kept = records.keep_first(first.unionByName(again), "event_id", ["ts", "source"])
    return kept.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "source", "event_type", "value"
    )


def largest_files(spark, sf_dir):
    files = _marked(spark, sf_dir).groupBy("file_name").agg(
        F.sum(F.octet_length("value")).alias("length"), F.count("*").alias("lines_processed")
    )
    largest = dumps.largest_first(files.withColumnRenamed("file_name", "path")).limit(S.TOP_FILES)
    return largest.select(F.col("path").alias("file_name"), F.col("length").alias("bytes"), "lines_processed")


def _samples(spark, sf_dir):
    samples = V.progress(spark, sf_dir)
    return samples.withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn(
        "position", F.col("lines_done")
    )


def rolling_rate(spark, sf_dir):
    rated = progress.rolling_rate(_samples(spark, sf_dir))
    return rated.select("run", "sample_id", "bytes_per_second", F.round("lines_per_second", 9).alias("lines_per_second"))


def eta(spark, sf_dir):
    samples = written(_samples(spark, sf_dir), "samples")
    rated = progress.eta(samples, progress.series_totals(samples))
    return rated.select("run", "sample_id", F.round("avg_speed", 6).alias("avg_speed"), "seconds_left")


def thread_depth(spark, sf_dir):
    return threads.thread_depth(V.thread(spark, sf_dir)).select("id", "post_id", "depth")


def thread_pruned(spark, sf_dir):
    keep = threads.keeps(F.col("author"), F.col("body"))
    return threads.thread_depth(V.thread(spark, sf_dir), keep=keep).select("id", "post_id", "depth")


def thread_max_depth(spark, sf_dir):
    keep = threads.keeps(F.col("author"), F.col("body"))
    return threads.thread_depth(V.thread(spark, sf_dir), S.MAX_DEPTH, keep).select("id", "post_id", "depth")


def comment_projection(spark, sf_dir):
    """Comments written as dump lines, with the type prefixes of dumps, and read back."""
    kept = V.thread(spark, sf_dir).where(threads.keeps(F.col("author"), F.col("body")))
    record = F.struct(
        "id", F.concat(F.lit("t3_"), "post_id").alias("link_id"), F.concat(F.lit("t1_"), "parent_id").alias("parent_id"),
        "author", "body", F.lit("x").alias("subreddit"),
    )
    parsed = records.parse_lines(kept.select(F.to_json(record).alias("value")))
    return records.select_comments(parsed).select("id", "post_id", "parent_id", "author", "body")


def comments_per_post(spark, sf_dir):
    starts = V.table(spark, sf_dir, "conversations").where("turn = 0").select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("id"),
        F.col("role").alias("started_by"),
        F.col("text").alias("opening"),
    )
    return threads.posts_with_comments(starts, V.thread(spark, sf_dir))


def remove_urls(spark, sf_dir):
    return _dataset(spark, sf_dir).select("id", X.remove_urls(F.col("text")).alias("text"))


def remove_punct(spark, sf_dir):
    return _dataset(spark, sf_dir).select("id", X.remove_punctuation(F.col("text")).alias("text"))


def remove_non_ascii(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.remove_non_ascii(F.col("text")).alias("text"))


def tokenize(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", X.join_tokens(F.col("tokens")).alias("tokens"), F.size("tokens").cast("bigint").alias("n"))


def _stopwords(spark):
    """The English list united with a file of further words."""
    path = scratch_folder(spark, "stopwords")
    spark.createDataFrame([(f" {word} ",) for word in S.CUSTOM_STOPWORDS], "value string").write.text(path)
    return X.load_stopwords("english", path, spark)


def remove_stopwords(spark, sf_dir):
    words = _stopwords(spark)
    return _plain(spark, sf_dir).select("id", X.join_tokens(X.remove_stopwords(F.col("tokens"), words)).alias("tokens"))


def remove_short(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", X.join_tokens(X.remove_short(F.col("tokens"))).alias("tokens"))


def stopword_hits(spark, sf_dir):
    """How often each word of the united stopword lists occurs."""
    words = _stopwords(spark)
    found = _plain(spark, sf_dir).select(F.explode("tokens").alias("word")).where(F.col("word").isin(words))
    return found.groupBy("word").agg(F.count("*").alias("n"))


def lemma_table(spark, sf_dir):
    return lemmas.lemma_table(lemmas.vocabulary(_shortened(spark, sf_dir)))


def lemmatize(spark, sf_dir):
    spelled = lemmas.lemmatize(_shortened(spark, sf_dir).select("id", "tokens"), "id")
    return spelled.select("id", X.join_tokens(F.col("tokens")).alias("tokens"))


def clean(spark, sf_dir):
    return _clean(spark, sf_dir)


def term_counts(spark, sf_dir):
    return tfidf.term_counts(_clean(spark, sf_dir))


def doc_freq(spark, sf_dir):
    docs = written(_clean(spark, sf_dir), "clean")
    table = tfidf.smooth_idf(tfidf.doc_freq(docs), docs.count())
    return table.select("term", "df", F.round("idf", 6).alias("idf"))


def vocabulary(spark, sf_dir):
    return tfidf.vocabulary(_clean(spark, sf_dir))


def tfidf_weights(spark, sf_dir):
    docs = written(_clean(spark, sf_dir), "clean")
    return tfidf.tfidf(docs, tfidf.fit_idf(docs)).select("id", "term", F.round("weight", 6).alias("weight"))


def smooth_tfidf(spark, sf_dir):
    """The weights of the vector stage, taken apart again."""
    docs = written(_clean(spark, sf_dir), "clean")
    model = SmoothTfidf().fit(docs)
    names = spark.createDataFrame(list(enumerate(model.stages[1].vocabulary)), "at int, term string")
    slots = F.posexplode(vector_to_array("features")).alias("at", "weight")
    weights = model.transform(docs).select("id", slots).where("weight <> 0")
    return weights.join(names, "at").select("id", "term", F.round("weight", 6).alias("weight"))


def stored_dataset(spark, sf_dir):
    """The cleaned dataset written as Parquet and CSV; the CSV is what training reads."""
    folder = scratch_folder(spark, "dataset")
    write_dataset(_clean(spark, sf_dir).select("label_post", "text_clean"), folder)
    return read_training_csv(spark, f"{folder}/csv")


def stored_weights(spark, sf_dir):
    """TF-IDF weights of the stored Parquet dataset, written and read."""
    folder = scratch_folder(spark, "weights")
    write_dataset(_clean(spark, sf_dir), f"{folder}/dataset")
    docs = read_dataset(spark, f"{folder}/dataset", "id", "text_clean")
    write_weights(tfidf.tfidf(docs, tfidf.fit_idf(docs)), f"{folder}/weights")
    return spark.read.parquet(f"{folder}/weights").select("id", "term", F.round("weight", 6).alias("weight"))


def label_set(spark, sf_dir):
    return evaluation.label_set(_dataset(spark, sf_dir), "label_post")


def class_weights(spark, sf_dir):
    weights = sampling.class_weights(_dataset(spark, sf_dir), "label_post")
    return weights.select("label_post", "n", F.round("weight", 9).alias("weight"))


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_dataset(spark, sf_dir).select("id", "label_post"), "id", "label_post", seed=S.SEED)


def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(_dataset(spark, sf_dir).select("id", "label_post"), "id", "label_post", seed=S.SEED)


def gaussian_nb_predict(spark, sf_dir):
    docs = written(
        sampling.stratified_split(written(_clean(spark, sf_dir), "clean"), "id", "label_post", seed=S.SEED), "split"
    )
    fit = bayes.fit_bayes(docs.where("NOT is_valid"), "label_post")
    valid = docs.where("is_valid")
    predicted = bayes.predict_bayes(fit, valid, [S.BAYES_SMOOTHING])
    return valid.select("id", F.col("label_post").alias("label")).join(predicted, "id").select(
        "id", "label", F.col("prediction_0").alias("prediction")
    )


def _pairs(spark, sf_dir):
    return V.table(spark, sf_dir, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )


def confusion_counts(spark, sf_dir):
    return evaluation.confusion_counts(_pairs(spark, sf_dir))


def confusion_percent(spark, sf_dir):
    shares = evaluation.confusion_percent(evaluation.confusion_counts(_pairs(spark, sf_dir)))
    return shares.withColumn("percent", F.round("percent", 6))


def confusion_matrix(spark, sf_dir):
    wide = evaluation.confusion_matrix(evaluation.confusion_counts(_pairs(spark, sf_dir)), [0, 1])
    return wide.select("label", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


def classification_report(spark, sf_dir):
    report = evaluation.classification_report(_pairs(spark, sf_dir))
    return report.withColumns({name: F.round(name, 6) for name in ("precision", "recall", "f1")})


def _training(spark, sf_dir):
    rows = train.prepare(_clean(spark, sf_dir))
    return rows.where("NOT is_valid").drop("is_valid"), rows.where("is_valid").drop("is_valid")


def _held_out(spark, sf_dir, kind, grid):
    """Predictions for the validation rows by a model with one fixed parameter set."""
    rows, valid = _training(spark, sf_dir)
    model = train.fit_one(rows, kind, grid)
    return model.transform(valid).select(
        "id", F.col("label_post").alias("label"), F.col("prediction_label").alias("prediction")
    )


def _labelled(held_out):
    """Held-out rows with whether the prediction is one of their labels."""
    held_out = written(held_out, "held_out")
    labels = held_out.select(F.col("label").alias("prediction")).distinct().withColumn("known", F.lit(True))
    return held_out.join(joins.small(labels), "prediction", "left").select(
        "id", "label", F.coalesce("known", F.lit(False)).alias("known_label")
    )


def _beats_majority(held_out):
    """Whether the model is right at least as often as always naming the largest class."""
    by_label = held_out.groupBy("label").agg(
        F.count_if(F.col("label") == F.col("prediction")).alias("right"), F.count("*").alias("rows")
    )
    return by_label.agg(
        F.sum("rows").alias("n"), F.max("rows").alias("largest"), (F.sum("right") >= F.max("rows")).alias("beats_majority")
    )


def rf_predict(spark, sf_dir):
    return _labelled(_held_out(spark, sf_dir, "rf", S.FOREST))


def svm_predict(spark, sf_dir):
    return _labelled(_held_out(spark, sf_dir, "svm", S.MACHINE))


def rf_accuracy(spark, sf_dir):
    return _beats_majority(_held_out(spark, sf_dir, "rf", S.FOREST))


def svm_accuracy(spark, sf_dir):
    return _beats_majority(_held_out(spark, sf_dir, "svm", S.MACHINE))


def grid_scores(spark, sf_dir):
    """Mean accuracy per smoothing value over stratified folds of the training rows."""
    rows, _ = _training(spark, sf_dir)
    tuned = train.tune(rows, "nb", {"var_smoothing": bayes.SMOOTHING}, folds=S.FOLDS, parallelism=4)
    return tuned.scores.select("grid_index", F.round("score", 6).alias("score"))


def best_score(spark, sf_dir):
    return train.best_scores(written(grid_scores(spark, sf_dir), "scores"))


def _saved_model(spark, sf_dir):
    """A naive Bayes model with its cleaning, trained and loaded again, and the raw validation texts."""
    raw = _dataset(spark, sf_dir)
    cleaned, cleaning = preprocess_dataset(_texts(spark, sf_dir))
    folder = scratch_folder(spark, "model")
    train.train_and_evaluate(spark, cleaned, "nb", folder, cleaning, {"var_smoothing": [S.BAYES_SMOOTHING]}, folds=2)
    rows = sampling.stratified_split(raw.select("id", "label_post"), "id", "label_post", seed=S.SEED)
    texts = raw.join(rows.where("is_valid").select("id"), "id", "left_semi")
    return train.load_model(f"{folder}/model"), texts.select("id", "text", F.col("label_post").alias("label"))


def predict_batch(spark, sf_dir):
    model, texts = _saved_model(spark, sf_dir)
    return train.predict(model, texts, ("id", "label"), "text")


def predict_stream(spark, sf_dir):
    model, texts = _saved_model(spark, sf_dir)
    folder = scratch_folder(spark, "texts")
    texts.write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
    stream_predictions(model, arriving, f"{folder}/out", f"{folder}/state", ("id", "label")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "label", "prediction")


def stream_ingest(spark, sf_dir):
    """Dump lines written as text files, ingested as a stream, and the posts that are stored then."""
    folder = scratch_folder(spark, "ingest")
    V.lines(spark, sf_dir).select("file_name", "value").write.partitionBy("file_name").text(f"{folder}/in")
    path = F.col("_metadata.file_path")
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .text(f"{folder}/in")
        .select(path.alias("path"), F.regexp_extract(path, "file_name=([^/]+)/", 1).alias("file_name"), "value")
    )
    ingest_stream(lines, f"{folder}/out", f"{folder}/state", value=S.LINE_VALUE).awaitTermination()
    posts = read_committed(spark, f"{folder}/out", "submissions", schemas.SUBMISSIONS)
    return posts.select(
        "id", "author", "title", F.unix_seconds("created_utc").alias("created_epoch"), "selftext", "subreddit", "link",
        "score",
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        flair_dataset, label_counts, field_filter_contains, field_filter_any, record_projection, line_status_counts,
        file_counters, month_prune, ingest_totals, incremental_files, dedup_keep_first, largest_files, rolling_rate, eta,
        thread_depth, thread_pruned, thread_max_depth, comment_projection, comments_per_post, remove_urls, remove_punct,
        remove_non_ascii, tokenize, remove_stopwords, remove_short, stopword_hits, lemma_table, lemmatize, term_counts,
        doc_freq, vocabulary, smooth_tfidf, stored_dataset, stored_weights, label_set, class_weights, stratified_split, stratified_folds, gaussian_nb_predict,
        confusion_counts, confusion_percent, confusion_matrix, classification_report, rf_predict, rf_accuracy, svm_predict, svm_accuracy, grid_scores, best_score, predict_batch,
        predict_stream, stream_ingest,
    )
}
QUERIES["clean_text"] = clean
QUERIES["tfidf"] = tfidf_weights


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _configured(query) for name, query in QUERIES.items()}

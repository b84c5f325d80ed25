"""The engine as users call it: indexes on disk through their changes, keywords, streams, files of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyvec.engine import Engine, IndexConfig, SearchParameters
from polyvec.operators import codec as codecs
from polyvec.operators import encoder
from polyvec.operators.index import running_start
from polyvec.plans.base import ASSIGNED, SCORES, TOKENS, docs, every_query, read, top, workspace
from polyvec.plans.text_queries import TOKEN_SQL
from polyvec.plans.vector_queries import DECODED, _fixed_index, _rounded
from polyvec.sources import metadata_rows, vector_files
from polyvec.sources.store import Store, list_indices

SMALL = IndexConfig(start_from_scratch=10, buffer_size=40)  # so that few documents already go through all regimes
BUFFERED = 70  # documents of the first add


def _metadata(spark, sf_dir):
    """documents' columns for the documents that have vectors."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


def _engine(spark, sf_dir, **options) -> Engine:
    """Three adds: one that creates, one that is buffered, one that lets the codebook grow."""
    engine = Engine(spark, f"{workspace(spark)}/index", SMALL, **options)
    every, rows = docs(spark, sf_dir), _metadata(spark, sf_dir)
    for part in (f"doc_id < {BUFFERED}", f"doc_id >= {BUFFERED} and doc_id < {BUFFERED + 5}", f"doc_id >= {BUFFERED + 5}"):
        engine.add(every.where(part), rows.where(part))
    return engine


def engine_rows(spark, sf_dir):
    """The metadata after three adds, with the positions that they gave."""
    return _engine(spark, sf_dir).metadata()


def engine_after_deletes(spark, sf_dir):
    """The exact ten best after three adds and two deletes, the second by position; with metadata."""
    engine = _engine(spark, sf_dir)
    engine.delete_many([("lang = ?", ["fr"]), ("doc_id < ?", [3])])
    found = engine.search(every_query(spark, sf_dir), parameters=SearchParameters(digits=6), exact=True)
    return found.select("query_id", "rank", "doc_id", "score", "lang", "n_chars")


AFTER = "m as (select doc_id as was, row_number() over (order by doc_id) - 1 as p, lang, n_chars from documents where doc_id in (select doc_id from t) and lang <> 'fr'), live as (select was, p - 3 as doc_id, lang, n_chars from m where p >= 3)"


def engine_filtered(spark, sf_dir):
    """The same within a condition on metadata."""
    engine = _engine(spark, sf_dir)
    engine.delete("lang = ?", ["de"])
    found = engine.search(every_query(spark, sf_dir), parameters=SearchParameters(digits=6), exact=True, condition="n_chars >= ? AND lang != ?", values=[400, "es"], with_metadata=False)
    return found.select("query_id", "rank", "doc_id", "score")


def engine_eviction(spark, sf_dir):
    """An index of at most 60 documents: the newest stay."""
    return _engine(spark, sf_dir, most_documents=60).metadata().select("doc_id", "lang", "n_chars")


def engine_update(spark, sf_dir):
    """Metadata after a conditional change and a delete that sees it."""
    engine = _engine(spark, sf_dir)
    engine.update_metadata("n_chars < ?", [600], {"source": "short"})
    engine.delete("source = ? AND lang = ?", ["short", "en"])
    return engine.metadata()


def engine_info(spark, sf_dir):
    """Totals after adds and deletes, and what counting them again corrects: nothing."""
    engine = _engine(spark, sf_dir)
    engine.delete("lang = ?", ["fr"])
    wrong, own = engine.reconcile(), engine.info()
    return spark.createDataFrame([(own["documents"], own["tokens"], own["deleted"], len(wrong))], "documents long, tokens long, deleted long, corrected int")


def engine_compacted(spark, sf_dir):
    """Inverted lists after a compaction: positions are stored ids again, and codes those of the codebook."""
    engine = _engine(spark, sf_dir)
    engine.delete("lang = ?", ["fr"])
    engine.compact()
    assert engine.index.dead is None
    return engine.index.ivf.select("doc_id").distinct().join(engine.index.codes.select("doc_id", F.size("codes").alias("tokens")), "doc_id")


def engine_keywords(spark, sf_dir):
    """BM25 through an index that every change keeps up: published, then added to, updated and deleted from."""
    engine = Engine(spark, f"{workspace(spark)}/index", SMALL, text_columns=["text"])
    every = docs(spark, sf_dir)
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(every.select("doc_id"), "doc_id", "left_semi")
    engine.add(every.where("doc_id < 60"), rows.where("doc_id < 60"))
    engine.publish_text()
    engine.add(every.where("doc_id >= 60"), rows.where("doc_id >= 60"))
    engine.update_metadata("lang = ?", ["es"], {"text": "the licensed words of the license"})
    engine.delete("lang = ?", ["fr"])
    found = engine.keywords({0: "license OR the", 1: "of NOT license", 2: "licensed words", 3: "no valid ( query"}, None)
    return _rounded(found.select("query_id", "doc_id", "score"), None)


KEYWORDS_SQL = f"""with {TOKENS}, src as (select row_number() over (order by doc_id) - 1 as doc_id, case when lang = 'es' then 'the licensed words of the license' else text end as text from documents where doc_id in (select doc_id from t) and lang <> 'fr'),
{TOKEN_SQL.replace("from documents", "from src")},
tf as (select doc_id, {", ".join(f"len(list_filter(tokens, lambda x: x = '{w}')) as {w}" for w in ("license", "the", "of", "licensed", "words"))} from tok),
df as (select {", ".join(f"count(*) filter ({w} > 0) as d_{w}" for w in ("license", "the", "of", "licensed", "words"))} from tf),
p as (select doc_id, tf.*, {", ".join(f"greatest(ln((n - d_{w} + 0.5) / (d_{w} + 0.5)), 1e-6) * {w} * 2.2 / ({w} + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s_{w}" for w in ("license", "the", "of", "licensed", "words"))} from tf join dl using (doc_id) cross join tot cross join df),
s as (select 0 as query_id, doc_id, s_license + s_the as score from p where license + the > 0 union all select 1, doc_id, s_of + s_license from p where of > 0 and license = 0 union all select 2, doc_id, s_licensed + s_words from p where licensed > 0 and words > 0)
select cast(query_id as bigint) as query_id, rank, doc_id, score from ({top("s", 1 << 30)})""".replace("select doc_id, tf.*,", "select tf.*,")


def store_round_trip(spark, sf_dir):
    """Every token's centroid and buckets after the index was written and loaded."""
    store = Store(spark, f"{workspace(spark)}/index")
    store.save(_fixed_index(spark, sf_dir))
    back = store.load()
    return codecs.buckets(back.codes, back.codec).select("doc_id", "pos", "centroid_id", F.aggregate("buckets", F.lit(0), lambda s, x: s + x).alias("buckets"))


def store_indices(spark, sf_dir):
    """The indexes below a folder, one of them a copy, with their sizes."""
    root = workspace(spark)
    index = _fixed_index(spark, sf_dir)
    Store(spark, f"{root}/first").save(index)
    Store(spark, f"{root}/first").clone(f"{root}/second")
    return spark.createDataFrame([(name, Store(spark, f"{root}/{name}").load().codes.count()) for name in list_indices(spark, root)], "name string, documents long")


def _one_file(rows):
    """rows in one partition, after an exchange: they are made in many tasks, and the one that writes holds few of them."""
    return rows.repartition(1)


def stream_ingest(spark, sf_dir):
    """Documents that come as a stream of files, one a batch, each batch one version; then a stream of deletes."""
    from polyvec.streaming.ingest import deletions, ingest

    folder = workspace(spark)
    every = docs(spark, sf_dir).join(_metadata(spark, sf_dir), "doc_id")
    for k in range(3):
        _one_file(every.where(f"doc_id % 3 = {k}")).write.mode("append").parquet(f"{folder}/in")
    engine = Engine(spark, f"{folder}/index", SMALL)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ingest(stream, engine, f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(0, "lang = ?", ["fr"]), (1, "n_chars < ?", ["500"])], "n int, condition string, values array<string>").coalesce(1).write.parquet(f"{folder}/gone")
    gone = spark.readStream.schema("n int, condition string, values array<string>").parquet(f"{folder}/gone")
    deletions(gone, engine, f"{folder}/cp2").trigger(availableNow=True).start().awaitTermination()
    # Batches come in no set order, so positions are left out.
    return engine.metadata().drop("doc_id")


def npy_round_trip(spark, sf_dir):
    """All vectors as .npy files of single precision, read back and put together to documents."""
    folder = workspace(spark)
    rows = read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding")
    vector_files.write_npy_files(rows.coalesce(1), "embedding", folder, "<f4")
    back = vector_files.read_npy(spark, folder)
    lengths = docs(spark, sf_dir).select("doc_id", F.size("embs").alias("n"))
    whole = vector_files.documents(back.select("row", "values"), lengths)
    return whole.select("doc_id", F.posexplode("embs").alias("pos", "v")).select("doc_id", "pos", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def base64_round_trip(spark, sf_dir):
    """Each document's vectors as base64 of single precision and back."""
    coded = vector_files.to_base64(docs(spark, sf_dir))
    back = vector_files.decode_base64(coded)
    return back.select("doc_id", F.length("data").alias("size"), F.round(F.aggregate(F.flatten("embs"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def json_vectors(spark, sf_dir):
    """Each document's vectors as JSON text and back."""
    rows = docs(spark, sf_dir).select("doc_id", F.to_json("embs").alias("data"))
    return vector_files.from_json(rows, "data").select("doc_id", F.size("embs").alias("n"), F.round(F.aggregate(F.flatten("embs"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def padded_vectors(spark, sf_dir):
    """Documents filled up to seven vectors, and the mask of those that are there."""
    rows = docs(spark, sf_dir).select("doc_id", encoder.padded(F.col("embs"), 7, 64).alias("p"), encoder.mask(F.col("embs"), 7).alias("m"))
    return rows.select("doc_id", F.size("p").alias("n"), F.aggregate("m", F.lit(0), lambda s, x: s + x).alias("there"), F.round(F.aggregate(F.flatten("p"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def token_offsets(spark, sf_dir):
    """Where each document's words begin if all texts are put one after another."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    return running_start(rows, "doc_id", "n", "start")


def metadata_from_events(spark, sf_dir):
    """JSON objects as a metadata table: types by their first values, missing keys null."""
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("j")).collect()  # a request's worth of objects
    import json

    objects = [json.loads(r["j"]) | ({"big": True} if i % 2 else {"share": 0.5 * i}) for i, r in enumerate(rows)]
    return metadata_rows.from_rows(spark, objects)


def strided_units(spark, sf_dir):
    """Every 64th of the parts by size and key first: a sample of all sizes before the rest."""
    from polyvec.operators.units import strided

    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return strided(rows, ["p_size", "p_partkey"], 64).select("p_partkey", "place")


QUERIES = {f.__name__: f for f in (engine_rows, engine_after_deletes, engine_filtered, engine_eviction, engine_update, engine_info, engine_compacted, engine_keywords, store_round_trip, store_indices, stream_ingest, npy_round_trip, base64_round_trip, json_vectors, padded_vectors, token_offsets, metadata_from_events, strided_units)}

_META = "documents where doc_id in (select doc_id from t)"
_SUMS = f"with {TOKENS}, s as (select doc_id, count(*) as n, round(sum(list_sum(e)), 5) as total from t group by doc_id)"
SQL = {
    "engine_rows": f"with {TOKENS} select doc_id, lang, source, n_chars from {_META}",
    "engine_after_deletes": f"with {SCORES}, {AFTER}, f as ({top('(select query_id, live.doc_id, score from scores join live on live.was = scores.doc_id)')}) select query_id, rank, doc_id, score, lang, n_chars from f join live using (doc_id)",
    "engine_filtered": f"with {SCORES}, live as (select doc_id as was, row_number() over (order by doc_id) - 1 as doc_id, lang, n_chars from {_META} and lang <> 'de') {top('(select query_id, live.doc_id, score from scores join live on live.was = scores.doc_id where n_chars >= 400 and lang <> ' + chr(39) + 'es' + chr(39) + ')')}",
    "engine_eviction": f"with {TOKENS}, m as (select row_number() over (order by doc_id) - 1 as p, count(*) over () as n, lang, n_chars from {_META}) select p - greatest(n - 60, 0) as doc_id, lang, n_chars from m where p >= n - 60",
    "engine_update": f"with {TOKENS}, m as (select doc_id, lang, case when n_chars < 600 then 'short' else source end as source, n_chars from {_META}) select row_number() over (order by doc_id) - 1 as doc_id, lang, source, n_chars from m where not (source = 'short' and lang = 'en')",
    "engine_info": f"with {TOKENS}, gone as (select doc_id from documents where lang = 'fr') select count(distinct doc_id) as documents, count(*) as tokens, (select count(distinct doc_id) from t where doc_id in (select doc_id from gone)) as deleted, cast(0 as int) as corrected from t where doc_id not in (select doc_id from gone)",
    "engine_compacted": f"with {TOKENS}, c as (select doc_id, count(*) as n from t group by doc_id) select row_number() over (order by doc_id) - 1 as doc_id, cast(n as int) as tokens from c where doc_id not in (select doc_id from documents where lang = 'fr')",
    "engine_keywords": KEYWORDS_SQL,
    "store_round_trip": f"with {ASSIGNED}, {DECODED} select doc_id, cast(pos as int) as pos, cast(centroid_id as int) as centroid_id, cast(list_sum(b) as int) as buckets from coded",
    "store_indices": f"with {TOKENS} select name, (select count(distinct doc_id) from t) as documents from (values ('first'), ('second')) v(name)",
    "stream_ingest": f"with {TOKENS} select lang, source, n_chars from {_META} and lang <> 'fr' and n_chars >= 500",
    "npy_round_trip": f"with {TOKENS} select doc_id, pos, round(list_sum(e), 5) as total from t",
    "base64_round_trip": f"{_SUMS} select doc_id, cast(4 * ceil(n * 64 * 4 / 3.0) as int) as size, total from s",
    "json_vectors": f"{_SUMS} select doc_id, cast(n as int) as n, total from s",
    "padded_vectors": f"{_SUMS} select doc_id, 7 as n, cast(n as int) as there, total from s",
    "token_offsets": "select doc_id, n_chars as n, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from documents",
    "metadata_from_events": "with r as (select row_number() over (order by r_regionkey) - 1 as doc_id, r_regionkey::bigint as r_regionkey, r_name from region) select doc_id, r_regionkey, r_name, case when doc_id % 2 = 0 then 0.5 * doc_id end as share, case when doc_id % 2 = 1 then 1::bigint end as big from r",
    "strided_units": "with o as (select p_partkey, row_number() over (order by p_size, p_partkey) - 1 as i from part) select p_partkey, row_number() over (order by i % 64 <> 0, i) - 1 as place from o",
}

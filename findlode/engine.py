"""The engine as callers see it: build an index once, open it, and ask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.functions.prefix import numbered
from findlode.functions.session import checkpointed
from findlode.functions.text import safe_query
from findlode.operators import geometry, graph, index, metadata, scoring, training, vectors

MOST_RESULTS = 1024
MOST_EXTERNAL = 256
DEPTH = 200
STATES = ("set_config", "search_ready")


@dataclass
class Engine:
    """An index in a folder: postings (word, doc_id, feat_id, x, y, a, b, c, sig), idf, norms, and files (file_id, filename, ...)."""

    spark: SparkSession
    folder: str
    bits: int = 64
    configuration: dict[str, str] = field(default_factory=dict)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def state(self) -> str:
        """Whether all tables are there."""
        jvm = self.spark._jvm
        for name in ("postings", "idf", "norms", "files"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
            if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                return STATES[0]
        return STATES[1]

    def build(self, features: DataFrame, centroids: DataFrame, files: DataFrame) -> None:
        """features: (doc_id, feat_id, x, y, a, b, c, vec). Assigns words, signs residuals, and writes the tables.

        Residuals are turned by a rotation that is learned from them, to ``bits`` dimensions at most, and a signature has a
        bit for each; the rotation is kept beside the medians for queries from outside.
        Tables that are there already are kept, so a build that broke off goes on where it stopped.
        """
        if self._missing("postings"):
            near = vectors.nearest_words(features, centroids, 1).select("feat_id", "word")
            rows = checkpointed(vectors.residuals(features.join(near, "feat_id"), centroids))
            first = rows.select(F.size("residual").alias("n")).first()
            if first:
                matrix = training.rotation(rows, min(self.bits, first["n"]))
                turned = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
                self.spark.createDataFrame(turned, "bit int, row array<double>").write.mode("overwrite").parquet(f"{self.folder}/rotation")
                rows = rows.withColumn("residual", vectors.projected(F.col("residual"), matrix))
            med = vectors.median_vectors(vectors.medians(rows))
            signed = rows.join(med, "word").select("word", "doc_id", "feat_id", "x", "y", "a", "b", "c", vectors.signature(F.col("residual"), F.col("med")).alias("sig"))
            med.write.mode("overwrite").parquet(f"{self.folder}/medians")
            centroids.write.mode("overwrite").parquet(f"{self.folder}/centroids")
            index.written(signed, f"{self.folder}/postings")
        tf = index.term_counts(self._table("postings"))
        if self._missing("idf"):
            index.idf(tf, files.select(F.col("file_id").alias("doc_id"))).write.mode("overwrite").parquet(f"{self.folder}/idf")
        if self._missing("norms"):
            index.tfidf_norms(tf, self._table("idf")).write.mode("overwrite").parquet(f"{self.folder}/norms")
        if self._missing("files"):
            files.write.mode("overwrite").parquet(f"{self.folder}/files")

    def _missing(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _query(self, boxes: DataFrame) -> DataFrame:
        """The features in each query's rectangle. boxes: (query_id, doc_id, xl, xu, yl, yu), a null bound bounding nothing."""
        rows = self._table("postings").join(boxes, "doc_id")
        for c in "xy":
            lo, hi = F.least(f"{c}l", f"{c}u"), F.greatest(f"{c}l", f"{c}u")
            rows = rows.filter((F.col(f"{c}l").isNull() | (F.col(c) >= F.when(F.col(f"{c}u").isNull(), F.col(f"{c}l")).otherwise(lo))) & (F.col(f"{c}u").isNull() | (F.col(c) <= F.when(F.col(f"{c}l").isNull(), F.col(f"{c}u")).otherwise(hi))))
        return rows.select("query_id", F.col("feat_id").alias("q_feat"), "word", F.col("sig").alias("q_sig"), *[F.col(c).alias(f"q_{c}") for c in ("x", "y", "a", "b", "c")])

    def represented(self, features: DataFrame, knn: int = 3) -> DataFrame:
        """Features from outside as a query's: (query_id, q_feat, x, y, a, b, c, vec) under their ``knn`` nearest words each."""
        centroids, med = self._table("centroids"), self._table("medians")
        near = vectors.nearest_words(features.select(F.col("q_feat").alias("feat_id"), "vec"), centroids, knn).select(F.col("feat_id").alias("q_feat"), "word")
        matrix = [r["row"] for r in self._table("rotation").orderBy("bit").collect()]
        rows = vectors.residuals(features.join(near, "q_feat"), centroids).join(med, "word").withColumn("residual", vectors.projected(F.col("residual"), matrix))
        return rows.select("query_id", "q_feat", "word", vectors.signature(F.col("residual"), F.col("med")).alias("q_sig"), *[F.col(c).alias(f"q_{c}") for c in ("x", "y", "a", "b", "c")])

    def _pairs(self, query: DataFrame, first: DataFrame) -> DataFrame:
        postings = self._table("postings").join(first.select("doc_id").distinct(), "doc_id", "left_semi")
        weights = scoring.match_weights(query.select("query_id", "q_feat", "word", "q_sig"), postings, self._table("idf"), self.bits).join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        chosen = scoring.putative(weights)
        places = query.select("query_id", "q_feat", *[f"q_{c}" for c in "xyabc"]).distinct()
        return chosen.join(places, ["query_id", "q_feat"]).join(postings.select("feat_id", "x", "y", "a", "b", "c"), "feat_id")

    def search_features(self, query: DataFrame, most: int = MOST_RESULTS, spatial: bool = True, keep_unverified: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank, ...): Hamming embedding, then the first ``DEPTH`` by a common transform."""
        scores = scoring.hamming(query.select("query_id", "q_feat", "word", "q_sig"), self._table("postings"), self._table("idf"), self._table("norms"), self.bits)
        first = scoring.top(scores, max(most, DEPTH))
        if not spatial:
            return first.filter(F.col("rank") <= most)
        found = geometry.reranked(first, self._pairs(query, first.filter(F.col("rank") <= DEPTH)), DEPTH, keep_unverified=keep_unverified)
        return scoring.top(found, most)

    def search(self, boxes: DataFrame, most: int = MOST_RESULTS, spatial: bool = True) -> DataFrame:
        """Searches by rectangles of indexed images, any number at once, with the results' file names."""
        found = self.search_features(self._query(boxes), most, spatial)
        return found.join(self._table("files").select(F.col("file_id").alias("doc_id"), "filename"), "doc_id")

    def show_match(self, boxes: DataFrame, doc_id: int) -> DataFrame:
        """Which features of a query and of one document fit a common transform, and that transform."""
        query = self._query(boxes)
        one = boxes.select("query_id", F.lit(doc_id).cast("bigint").alias("doc_id")).distinct()
        return geometry.verified(self._pairs(query, one)).filter("inliers >= 4")

    def filelist(self, mode: str = "all", query: str = "", by: str | None = None, group: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """File ids: all, or by a text query; a group's ids don't mind the query. Without bounds a random hundred."""
        files = self._table("files")
        if by is not None and group is not None:
            ids = metadata.group_members(files, by, group)
        elif mode == "fts":
            names = [c for c in files.columns if c != "file_id"]
            ids = metadata.search(safe_query(query), files, metadata.token_table(metadata.joined_text(files, None, names)))
        else:
            ids = files.select("file_id")
        if start is None and end is None:
            return metadata.sampled(ids, "file_id")
        return metadata.paged(ids, ["file_id"], start or 0, end or 0)

    def search_external(self, features: DataFrame, most: int = MOST_EXTERNAL, spatial: bool = True) -> DataFrame:
        """Searches by features of images that aren't indexed, as ``represented`` takes them, with fewer results."""
        found = self.search_features(self.represented(features), most, spatial)
        return found.join(self._table("files").select(F.col("file_id").alias("doc_id"), "filename"), "doc_id")

    def register(self, left: DataFrame, right: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """The transform from an image, or a rectangle (xl, xu, yl, yu) of it, to another. Both: (feat_id, vec, x, y, a, b, c)."""
        return geometry.registered(index.region_of_interest(left, *box) if box else left, right)

    def _asked(self, name: str, boxes: DataFrame, most: int, batch: int) -> DataFrame:
        """(query_id, doc_id, score, h) of all queries, in batches; a query that an earlier run has finished isn't asked again.

        A batch's results and the marks of its queries (rows without a document) are committed together.
        """
        path, kept = f"{self.folder}/{name}", "query_id bigint, doc_id bigint, score double, h array<double>"
        empty = self.spark.createDataFrame([], kept)
        if self._missing(name):
            empty.write.mode("overwrite").parquet(path)
        left = checkpointed(graph.unfinished(boxes.select("query_id").distinct(), self.spark.read.schema(kept).parquet(path).select("query_id").distinct()))
        n = max(1, -(-left.count() // batch))
        for k in range(n):
            some = checkpointed(left.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k))
            found = self.search(boxes.join(some, "query_id", "left_semi"), most).select("query_id", "doc_id", "score", "h")
            found.unionByName(some.select("query_id"), allowMissingColumns=True).write.mode("append").parquet(path)
        return self.spark.read.schema(kept).parquet(path).join(boxes.select("query_id").distinct(), "query_id", "left_semi")

    def _whole(self, ids: DataFrame) -> DataFrame:
        queries = ids.select(F.col("file_id").alias("query_id")).distinct()
        return queries.select("query_id", F.col("query_id").alias("doc_id"), *[F.lit(None).cast("double").alias(c) for c in ("xl", "xu", "yl", "yu")])

    def visual_groups(self, ids: DataFrame, most: int = 100, least_score: float = 10.0, batch: int = 1024) -> DataFrame:
        """(set_id, set_size, members) of files that find each other. Queries that are finished are not asked again."""
        found = self._asked("vgroup_files", self._whole(ids), most, batch)
        edges = found.filter((F.col("doc_id") != F.col("query_id")) & (F.col("score") >= least_score))
        return graph.sets(graph.components(edges.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), "score")))

    def unmatched(self, ids: DataFrame, most: int = 100, least_score: float = 10.0, batch: int = 1024) -> DataFrame:
        """(query_id, result_count, max_score) of files that find no other file well enough, from the same searches."""
        found = self._asked("vgroup_files", self._whole(ids), most, batch).filter("doc_id is not null")
        return graph.non_matches(found, ids.select(F.col("file_id").alias("query_id")).distinct(), least_score)

    def visual_region_groups(self, regions: DataFrame, most: int = 100, least_score: float = 10.0, least_overlap: float = 0.9, batch: int = 1024) -> tuple[DataFrame, DataFrame]:
        """Sets of regions that find each other, and all regions: those given and those that matches have added.

        regions: (region_id, file_id, x, y, w, h). A match is the rectangle that the region is moved to; one that overlaps
        a region of its file enough is that region, and any other becomes a region of its own.
        """
        queries = regions.select(F.col("region_id").alias("query_id"), F.col("file_id").alias("doc_id"), F.col("x").alias("xl"), (F.col("x") + F.col("w")).alias("xu"), F.col("y").alias("yl"), (F.col("y") + F.col("h")).alias("yu"))
        found = self._asked("vgroup_regions", queries, most, batch).filter((F.col("score") >= least_score) & F.col("h").isNotNull())
        own = regions.select(F.col("region_id").alias("query_id"), F.col("file_id").alias("own"), "x", "y", "w", F.col("h").alias("height"))
        moved = found.join(own, "query_id").filter("doc_id != own").withColumn("to", geometry.match_region(F.col("x"), F.col("y"), F.col("w"), F.col("height"), F.col("h")))
        matches = checkpointed(numbered(moved.select("query_id", F.col("doc_id").alias("file_id"), "score", "to.*"), ["query_id", "file_id"], "match_key"))
        ids = checkpointed(geometry.assigned_regions(matches.select("match_key", "file_id", "x", "y", "w", "h"), regions, least_overlap))
        edges = matches.join(ids.select("match_key", "region_id"), "match_key").select(F.col("query_id").alias("src"), F.col("region_id").alias("dst"), "score")
        fresh = matches.join(ids.filter("fresh").select("match_key", "region_id"), "match_key").select("region_id", "file_id", "x", "y", "w", "h")
        return graph.sets(graph.components(edges)), regions.select(fresh.columns).unionByName(fresh)

    def sets_page(self, sets: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
        """A page of sets, by their numbers."""
        return metadata.paged(sets, ["set_id"], start, end, metadata.SET_PAGE)

    def sets_with(self, sets: DataFrame, file_id: int) -> DataFrame:
        """The sets that hold a file."""
        return graph.sets_with(sets, self.spark.createDataFrame([(file_id,)], "member_id bigint"))

"""Books from block streams: global order, table-of-contents cuts, slices, image sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions.text import FRONT_MATTER, WHOLE_BOOK


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def global_order(blocks: DataFrame) -> DataFrame:
    """Add `block_index`, the place of a block in its book: by spine_idx, then seq."""
    order = W.partitionBy("book_id").orderBy("spine_idx", "seq")
    return blocks.withColumn("block_index", (F.row_number().over(order) - 1).cast("int"))


def _endings(path: Column) -> Column:
    """All endings of a base name, the empty one included."""
    return F.transform(F.sequence(F.lit(1), F.length(base_name(path)) + 1), lambda i: F.substring(base_name(path), i, 1_000_000))


def match_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Add `file` and `spine_idx` of the first file, in spine order, that an entry's file names: the same path, the same
    base name, or one path ending with the other; failing all files, the same base name in other case.

    Files are looked up by base name; a path ends with one of another base name only if that has no folder, so for
    those all endings of base names are looked up too. Of the files of one name only the first is looked up, so an entry meets one row a name,
    however many files have it.
    """
    key = ["book_id", "toc_index"]
    wanted, have = F.col("toc_file"), F.col("file")
    asked = entries.where("toc_file <> ''").select(*key, "toc_file")
    listed = files.select("book_id", "spine_idx", "file")

    def met(names: DataFrame, own: DataFrame, name: Column, tier: int) -> DataFrame:
        first = own.select("book_id", name.alias("__e"), F.struct(F.lit(tier).alias("tier"), "spine_idx", "file").alias("__m")).groupBy("book_id", "__e").agg(F.min("__m").alias("__m"))
        return names.join(first, ["book_id", "__e"]).select(*key, "__m")

    bare_files, bare_entries = listed.where(~have.contains("/")), asked.where(~wanted.contains("/"))
    named = met(asked.withColumn("__e", base_name(wanted)), listed, base_name(have), 0)
    cased = met(asked.withColumn("__e", F.lower(base_name(wanted))), listed, F.lower(base_name(have)), 1)
    ends = met(asked.withColumn("__e", F.explode(_endings(wanted))), bare_files, have, 0)
    ended = met(bare_entries.withColumn("__e", wanted), listed, F.explode(_endings(have)), 0)
    best = named.unionByName(cased).unionByName(ends).unionByName(ended).groupBy(*key).agg(F.min("__m").alias("__m"))
    return entries.join(best, key, "left").select(*entries.columns, F.col("__m.file").alias("file"), F.col("__m.spine_idx").alias("spine_idx"))


def locate(entries: DataFrame, anchors: DataFrame, starts: DataFrame) -> DataFrame:
    """Add `block_index` to matched entries: their fragment in the matched file, else in the book's last file that has
    such an anchor, else the file's first block. Entries without a file are dropped.

    anchors: book_id, spine_idx, fragment, block_index; starts: book_id, spine_idx, start.
    """
    own = anchors.groupBy("book_id", "spine_idx", "fragment").agg(F.min("block_index").alias("own_index"))
    any_file = anchors.groupBy("book_id", "fragment").agg(F.max_by("block_index", "spine_idx").alias("any_index"))
    joined = entries.where("file IS NOT NULL").join(own, ["book_id", "spine_idx", "fragment"], "left").join(any_file, ["book_id", "fragment"], "left").join(starts, ["book_id", "spine_idx"])
    return joined.withColumn("block_index", F.coalesce("own_index", "any_index", "start").cast("int")).drop("own_index", "any_index", "start")


def dedupe_cuts(cuts: DataFrame) -> DataFrame:
    """One cut for each block: the one of the least depth, then the first."""
    order = W.partitionBy("book_id", "block_index").orderBy("depth", "toc_index")
    return cuts.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def heading_cuts(blocks: DataFrame) -> DataFrame:
    """Cuts at first and second level headings of under 120 characters."""
    found = blocks.where((F.col("type") == "heading") & F.col("level").isin(1, 2) & (F.length("text") < 120))
    return found.select("book_id", "block_index", F.col("text").alias("title"), F.lit(0).alias("depth"), F.col("block_index").alias("toc_index"))


def slice_by_cuts(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add `chapter_order`, `title` and `paragraph_order`: a chapter is the blocks from its cut to the next.

    Blocks before the first cut are the front matter; a book without cuts is one chapter.
    """
    at = cuts.select("book_id", "block_index", F.col("title").alias("__title"))
    order = W.partitionBy("book_id").orderBy("block_index")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    book = W.partitionBy("book_id")
    marked = blocks.join(at, ["book_id", "block_index"], "left").withColumns(
        {
            "__nth": F.count("__title").over(so_far),
            "__n": F.count("__title").over(book),
            "__front": F.max(F.when(F.col("block_index") == 0, F.col("__title").isNull().cast("int")).otherwise(0)).over(book),
            "__name": F.last("__title", ignorenulls=True).over(so_far),
        }
    )
    chapter = F.when(F.col("__nth") == 0, 0).otherwise(F.col("__nth") - 1 + F.col("__front")).cast("int")
    title = F.when(F.col("__n") == 0, WHOLE_BOOK).when(F.col("__nth") == 0, FRONT_MATTER).otherwise(F.col("__name"))
    named = marked.withColumns({"chapter_order": chapter, "title": title})
    return named.withColumn("paragraph_order", (F.row_number().over(W.partitionBy("book_id", "chapter_order").orderBy("block_index")) - 1).cast("int")).select(*blocks.columns, "chapter_order", "title", "paragraph_order")


def build_book(blocks: DataFrame, toc_cuts: DataFrame) -> DataFrame:
    """Slice each book by its top-level table of contents if that gives two cuts or more, else by headings."""
    top = dedupe_cuts(toc_cuts.where("depth = 0"))
    enough = top.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("book_id")
    columns = ["book_id", "block_index", "title"]
    cuts = top.join(enough, "book_id", "left_semi").select(columns).union(heading_cuts(blocks).join(enough, "book_id", "left_anti").select(columns))
    return slice_by_cuts(blocks, cuts)


def resolve_images(images: DataFrame, assets: DataFrame) -> DataFrame:
    """Add `image_url`: the asset of the same path, of the path relative to the document's folder, of the same base name
    (the first by asset_idx), else the source itself. images: book_id, file, image_src; assets: book_id, asset_idx, path, url."""
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    relative = F.when(folder != "", F.concat(folder, F.lit("/"), F.col("image_src"))).otherwise(F.col("image_src"))
    by_path = assets.groupBy("book_id", "path").agg(F.min_by("url", "asset_idx").alias("url"))
    by_name = assets.groupBy("book_id", base_name(F.col("path")).alias("__name")).agg(F.min_by("url", "asset_idx").alias("__by_name"))
    keyed = images.withColumns({"__rel": relative, "__name": base_name(F.col("image_src"))})
    exact = keyed.join(by_path.select("book_id", F.col("path").alias("image_src"), F.col("url").alias("__exact")), ["book_id", "image_src"], "left")
    near = exact.join(by_path.select("book_id", F.col("path").alias("__rel"), F.col("url").alias("__relative")), ["book_id", "__rel"], "left")
    named = near.join(by_name, ["book_id", "__name"], "left")
    url = F.when(F.col("image_src") == "", "").otherwise(F.coalesce("__exact", "__relative", "__by_name", "image_src"))
    return named.withColumn("image_url", url).select(*images.columns, "image_url")


def safe_asset_names(assets: DataFrame) -> DataFrame:
    """Add `safe_name`: the base name with odd characters replaced; repeats in a book get _1, _2, ... before the extension."""
    from foliomill.functions.text import safe_file_name

    name = safe_file_name(base_name(F.col("path")))
    nth = F.row_number().over(W.partitionBy("book_id", "__name").orderBy("asset_idx")) - 1
    stem, ext = F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 2)
    numbered = assets.withColumn("__name", name).withColumn("__nth", nth)
    return numbered.withColumn("safe_name", F.when(F.col("__nth") == 0, F.col("__name")).otherwise(F.concat(stem, F.lit("_"), F.col("__nth"), ext))).drop("__name", "__nth")

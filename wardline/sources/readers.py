"""Readers with explicit schemas: evaluation corpora, prompt sources, manifests, canonical rows, landed images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.canonical import DDL
from ..operators.profile import hash_order
from ..operators.profile import split as split_rows
from ..operators.spans import parse_markup

MASK = "array<struct<start:int,end:int,label:string,value:string>>"
PROMPTS = "input_id string, text string, label int, source string, language string, category string, expected_action string"
#: Registered corpora: kind of reader, and names of the text and mask columns.
CORPORA = {"pii_masking_95k": ("mask", "source_text", "privacy_mask"), "vie_pii": ("markup", "output", None)}
PROMPT_SOURCES = {
    "local_vietnamese_seed": "jsonl", "local_vietnamese_app_seed": "jsonl", "local_vietnamese_mentor_seed": "jsonl", "deepset": "table", "deepset_vi": "twins", "llmail_vi": "twins", "pi_vi_eval": "eval",
}
ALIASES = {"val": "validation"}


def corpus(name: str) -> tuple[str, str, str | None]:
    """Kind of reader, text column and mask column of a registered corpus."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}; there are {', '.join(sorted(CORPORA))}")
    return CORPORA[name]


def prompt_source(name: str) -> str:
    """Kind of reader of a registered prompt source."""
    if name not in PROMPT_SOURCES:
        raise ValueError(f"unknown prompt source {name!r}; there are {', '.join(sorted(PROMPT_SOURCES))}")
    return PROMPT_SOURCES[name]


def mask_of(column: Column, kind: str) -> Column:
    """A privacy mask from an array or JSON text; null and empty give no spans."""
    none = F.array().cast(MASK)
    return F.coalesce(F.from_json(column, MASK) if kind == "string" else column.cast(MASK), none)


def evaluation_rows(frames: dict[str, DataFrame], name: str, text: str = "source_text", mask: str = "privacy_mask", split: str = "all", limit: int | None = None, seed: int = 42) -> DataFrame:
    """Rows input_id, source_text, split, privacy_mask of one split or all; `limit` samples each split by hash.

    frames: split to rows, with an input_id or a source_index (a row's place in its split), of which the id name:split:source_index is
    made: a table by itself has no order.  Where there are no train_main and train_val, they are nine and one tenths of train.
    """
    wanted = ALIASES.get(split, split)
    if wanted in ("train_main", "train_val") and wanted not in frames and "train" in frames:
        key = "input_id" if "input_id" in frames["train"].columns else "source_index"
        parts_of = split_rows(frames["train"], key, {"train_val": 0.1, "train_main": 0.9}, seed)
        frames = {wanted: parts_of.where(F.col("part") == wanted).drop("part")}
    if wanted != "all" and wanted not in frames:
        raise ValueError(f"{name} has no split {split!r}; there are {', '.join(frames)}")
    parts = []
    for k in frames if wanted == "all" else [wanted]:
        df = own = frames[k]
        if not {"input_id", "source_index"} & set(df.columns):
            raise ValueError(f"the rows of {name}:{k} need an input_id or a source_index")
        ident = F.col("input_id").cast("string") if "input_id" in df.columns else F.concat_ws(":", F.lit(name), F.lit(k), F.col("source_index").cast("string"))
        own = own.select(ident.alias("input_id"), F.col(text).alias("source_text"), F.lit(k).alias("split"), mask_of(F.col(mask), dict(df.dtypes)[mask]).alias("privacy_mask"))
        parts.append(own.orderBy(hash_order("input_id", seed), "input_id").limit(limit) if limit is not None else own)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markup_rows(df: DataFrame, name: str, split: str, column: str = "output", index: str = "source_index") -> DataFrame:
    """Rows of inline markup as evaluation rows, with the number of inline labels."""
    clean, spans = parse_markup(F.col(column))
    return df.select(F.concat_ws(":", F.lit(name), F.lit(split), F.col(index).cast("string")).alias("input_id"), clean.alias("source_text"), F.lit(split).alias("split"), spans.alias("privacy_mask"), F.size(spans).alias("inline_label_count"))


def jsonl_prompts(spark: SparkSession, path: str, name: str, split: str = "test") -> DataFrame:
    """Local prompt examples of one file; blank lines are skipped, a missing id is name:line (from 1, blank lines count).

    The file is read whole for its line numbers: local sets are small.
    """
    if split not in ("test", "all"):
        raise ValueError(f"{name} has the splits test and all, not {split!r}")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "")
    rows = lines.select("line", F.from_json("value", PROMPTS).alias("r")).select("line", "r.*")
    own = {"input_id": F.concat_ws(":", F.lit(name), (F.col("line") + 1).cast("string")), "source": F.lit(name), "language": F.lit("vi")}
    return rows.select(*[F.coalesce(c, own[c]).alias(c) if c in own else F.col(c) for c in rows.columns if c != "line"])


def prompt_rows(df: DataFrame, name: str, split: str, index: str = "row_index") -> DataFrame:
    return df.select(F.concat_ws(":", F.lit(name), F.lit(ALIASES.get(split, split)), F.col(index).cast("string")).alias("input_id"), "text", F.col("label").cast("int").alias("label"), F.lit(name).alias("source"))


def twin_prompts(rows: DataFrame, name: str) -> DataFrame:
    """Examples of translated canonical rows with text and a known label."""
    text = F.trim("content.input_text")
    kept = rows.where(F.col("augmentation").isNotNull() & (F.length(text) > 0) & F.col("labels.prompt_injection").isNotNull())
    return kept.select("input_id", text.alias("text"), F.col("labels.prompt_injection").cast("int").alias("label"), F.lit(name).alias("source"), F.lit("vi").alias("language"), F.when(F.col("labels.prompt_injection"), "attack").otherwise("benign").alias("category"))


def eval_prompts(rows: DataFrame) -> DataFrame:
    """Examples of the balanced evaluation set: label and bucket from the eval struct."""
    return rows.where("eval is not null").select("input_id", F.col("content.input_text").alias("text"), F.col("eval.label").cast("int").alias("label"), F.lit("pi_vi_eval").alias("source"), F.col("eval.bucket").alias("category"))


def limited(rows: DataFrame, n: int, order: str, id_col: str = "input_id", seed: int = 42) -> DataFrame:
    """n rows chosen by hash, back in source order."""
    return rows.orderBy(hash_order(id_col, seed), id_col).limit(n).orderBy(order)


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (place, input_id) of a manifest: a JSON list of ids, or an object with input_ids."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    ids = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.from_json("v", "struct<input_ids:array<string>>")["input_ids"])
    first = text.select(F.posexplode(ids).alias("place", "input_id"))
    return first.groupBy("input_id").agg(F.min("place").alias("place"))


def canonical_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DDL).json(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Landed image files: path, bytes and length; the content is read only where it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def cell_images(rows: DataFrame, image: str = "image") -> DataFrame:
    """Rows with image_bytes and image_path from a cell that is a struct, bytes or a path."""
    kind = dict(rows.dtypes)[image]
    if kind.startswith("struct"):
        return rows.withColumn("image_bytes", F.col(f"{image}.bytes")).withColumn("image_path", F.col(f"{image}.path"))
    if kind == "binary":
        return rows.withColumn("image_bytes", F.col(image)).withColumn("image_path", F.lit(None).cast("string"))
    return rows.withColumn("image_bytes", F.lit(None).cast("binary")).withColumn("image_path", F.col(image))


def extraction_counts(cells: DataFrame, have: DataFrame, id_col: str = "input_id", overwrite: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Image cells still to be written (id, image_bytes), and one row (written, skipped, missing): those that are there are skipped unless
    overwritten, cells without bytes are missing, `limit` takes the first ids."""
    cells = cells.orderBy(id_col).limit(limit) if limit is not None else cells
    there = have.select(id_col, F.lit(True).alias("_there"))
    marked = cells.join(there, id_col, "left").withColumn("_skip", F.coalesce("_there", F.lit(False)) & F.lit(not overwrite))
    empty = F.col("image_bytes").isNull()
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    counts = marked.agg(count(~F.col("_skip") & ~empty, "written"), count(F.col("_skip"), "skipped"), count(~F.col("_skip") & empty, "missing"))
    return marked.where(~F.col("_skip") & ~empty).select(id_col, "image_bytes"), counts


#: Kinds of files that hold review rows, in the order in which they are offered, and where they lie under the root.
REVIEW_PLACES = [
    ("review-queue", r"review/queue/[^/]*\.jsonl"), ("weak", r"weak/[^/]*/weak_labeled\.jsonl"), ("redacted", r"redacted/[^/]*/redacted\.jsonl"), ("ocr", r"ocr/[^/]*/ocr\.jsonl"),
    ("converted", r"converted/[^/]*/source_canonical\.jsonl"), ("sample", r"samples/(.*/)?[^/]*\.jsonl"),
]


def review_files(files: DataFrame, root: str, open_rows: DataFrame | None = None) -> DataFrame:
    """Rows (place, path, label) of the files to choose from: by kind, then path; a queue's label names its open rows.

    files: rows (path).  open_rows: rows (path, n) of queue rows that still need a review.
    """
    relative = F.when(F.startswith("path", F.lit(root + "/")), F.expr(f"substring(path, {len(root) + 2})"))
    kind, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, rx) in enumerate(REVIEW_PLACES):
        hit = F.col("rel").rlike(f"^{rx}$")
        kind, order = F.coalesce(kind, F.when(hit, name)), F.coalesce(order, F.when(hit, i))
    rows = files.select("path", relative.alias("rel")).withColumn("kind", kind).withColumn("order", order).where("kind is not null").distinct()
    counts = open_rows if open_rows is not None else files.select("path", F.lit(0).alias("n")).limit(0)
    rows = rows.join(counts, "path", "left")
    suffix = F.when(F.col("kind") == "review-queue", F.format_string(" (%d to review)", F.coalesce("n", F.lit(0)).cast("int"))).otherwise("")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order", "path"))  # a listing of files for one person
    return rows.select(place.alias("place"), "path", F.concat(F.lit("["), "kind", F.lit("] "), "rel", suffix).alias("label"))


def open_reviews(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows (path, n) of queue rows (path, input_id, status) that need a review and that no override has marked as reviewed."""
    done = overrides.where("status = 'human_reviewed'").select("input_id").distinct()
    return rows.where("status = 'needs_review'").join(done, "input_id", "left_anti").groupBy("path").agg(F.count("*").alias("n"))


def safe_path(path: str, root: str) -> str | None:
    """The path, absolute and without . and .., if it lies under the root (or is it); else None.  A relative path counts from the root.

    Only names are looked at: works for any file system.
    """
    import posixpath

    scheme, mark, rest = root.partition("://")
    base = posixpath.normpath(f"/{rest}" if mark else root)
    own = f"/{path.removeprefix(f'{scheme}://')}" if mark and path.startswith(f"{scheme}://") else path
    if "://" in own:
        return None
    full = posixpath.normpath(own if own.startswith("/") else posixpath.join(base, own))
    inside = full == base or full.startswith(base.rstrip("/") + "/")
    return (f"{scheme}:/{full}" if mark else full) if inside else None


def missing_only(rows: DataFrame, done: DataFrame, id_col: str = "input_id") -> DataFrame:
    """Rows that an earlier run hasn't finished."""
    return rows.join(done.select(id_col), id_col, "left_anti")


def positions(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds a 0-based place within each value of `by`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)

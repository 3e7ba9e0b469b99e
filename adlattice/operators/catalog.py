"""Placement-spec catalog: projection of raw rows, lookups, idempotent upsert, checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlattice import vocab
from adlattice.operators.scale import first_row, previous_row

INSETS = ("safe_top", "safe_right", "safe_bottom", "safe_left")


def _int(name: str, default: int | None = None) -> Column:
    number = F.col(name).cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def project_specs(raw: DataFrame) -> DataFrame:
    """Catalog rows from raw JSON rows; numbers are cut to whole ones, absent ones get their default."""
    ints = {"max_file_size_kb": "maxFileSizeKb", "min_file_size_kb": "minFileSizeKb", "safe_top": "safeTop",
            "safe_right": "safeRight", "safe_bottom": "safeBottom", "safe_left": "safeLeft",
            "safe_zone_width": "safeZoneWidth", "safe_zone_height": "safeZoneHeight",
            "headline_max_chars": "headlineMaxChars", "description_max_chars": "descriptionMaxChars",
            "text_max_pct": "textMaxPct"}
    texts = {"media": "media", "placement_name": "placementName", "slug": "slug", "aspect_ratio": "ratio",
             "ratio_label": "ratioLabel", "category": "category", "placement_type": "placementType",
             "source_url": "sourceUrl", "source_type": "sourceType", "source_ref": "sourceRef",
             "color_space": "colorSpace", "parse_status": "safeZoneParseStatus", "notes": "notes",
             "last_verified": "lastVerified", "last_updated": "lastUpdated"}
    bools = {"bg_transparent": "bgTransparent", "is_video": "isVideo", "needs_review": "needsReview"}
    flat = raw.select(
        *[F.col(v).alias(k) for k, v in texts.items()], _int("width", 0).alias("width"), _int("height", 0).alias("height"),
        (_int("id", 0) + 10000).alias("sort_order"), F.lit(True).alias("active"),
        *[_int(v).alias(k) for k, v in ints.items()], *[F.col(v).alias(k) for k, v in bools.items()],
        F.col("fileFormats").alias("file_formats"))
    return flat.withColumn("safe_zone", inset_map())


def inset_map(need_all: bool = True) -> Column:
    """Map of the four insets of a parsed zone; the lenient variant asks only for the top one."""
    known = F.col("parse_status") == "parsed_text"
    for c in (INSETS if need_all else INSETS[:1]):
        known = known & F.col(c).isNotNull()
    keys = ("top", "right", "bottom", "left")
    return F.when(known, F.create_map(*[x for k, c in zip(keys, INSETS) for x in (F.lit(k), F.col(c))]))


def default_specs(spark: SparkSession) -> DataFrame:
    """The 64 built-in placements, a literal table."""
    return spark.createDataFrame(
        [(*row, True) for row in vocab.DEFAULT_SPECS], "media string, placement_name string, slug string, width int, height int, aspect_ratio string, "
              "sort_order int, active boolean")


def init_specs(existing: DataFrame, defaults: DataFrame, reset: bool) -> DataFrame:
    """Defaults alone, or appended to what is there; nothing is de-duplicated."""
    return defaults if reset else existing.unionByName(defaults, allowMissingColumns=True)


# --- lookups -----------------------------------------------------------------------------------------------------

def all_specs(specs: DataFrame) -> DataFrame:
    return specs.orderBy("sort_order")


def active_specs(specs: DataFrame) -> DataFrame:
    return specs.filter("active").orderBy("sort_order")


def specs_by_media(specs: DataFrame, media: str) -> DataFrame:
    return specs.filter((F.col("media") == media) & F.col("active"))


def specs_by_media_in(specs: DataFrame, media: Sequence[str]) -> DataFrame:
    return specs.filter(F.col("media").isin(list(media)) & F.col("active"))


def specs_by_ids(specs: DataFrame, ids: DataFrame, key: str = "slug") -> DataFrame:
    """Specs whose id occurs in a table of ids, active or not."""
    return specs.join(ids.select(key), key, "left_semi")


def specs_by_slug(specs: DataFrame, slug: str) -> DataFrame:
    return specs.filter(F.col("slug") == slug)


def specs_by_placement(specs: DataFrame, placement_type: str) -> DataFrame:
    return specs.filter(F.col("placement_type") == placement_type)


def spec_one(specs: DataFrame, media: str, slug: str) -> DataFrame:
    """At most one row: the first in sort order."""
    return specs.filter((F.col("media") == media) & (F.col("slug") == slug)).orderBy("sort_order").limit(1)


def list_specs(specs: DataFrame, media: str | None = None, placement: str | None = None) -> DataFrame:
    if media and placement:
        return specs_by_media(specs, media).filter(F.col("placement_type") == placement)
    if media:
        return specs_by_media(specs, media)
    if placement:
        return specs_by_placement(specs, placement)
    return active_specs(specs)


def has_detail() -> Column:
    """A spec card has more to show; zero and empty text count as nothing."""
    def given(c: str, zero) -> Column:
        return F.coalesce(F.col(c) != F.lit(zero), F.lit(False))
    return (given("headline_max_chars", 0) | given("description_max_chars", 0)
            | F.coalesce(F.col("parse_status") == "diagram_unreadable", F.lit(False))
            | F.coalesce(~F.col("bg_transparent"), F.lit(False)) | given("last_verified", "") | given("source_url", ""))


def has_parsed_safe_zone() -> Column:
    any_side = F.coalesce(*[F.col(c) for c in INSETS]).isNotNull()
    return F.coalesce(F.col("parse_status") == "parsed_text", F.lit(False)) & any_side


# --- upsert ------------------------------------------------------------------------------------------------------

def upsert_specs(existing: DataFrame, incoming: DataFrame, order: str = "batch_ord", key: str = "slug",
                 compared: Sequence[str] = tuple(vocab.COMPARED_SPEC_FIELDS)) -> tuple[DataFrame, DataFrame]:
    """Merged catalog and one status row per incoming row.

    A row is compared with what the catalog holds when its turn comes: the previous row of its slug in the batch, or
    the stored one.  Equal in every compared field is UNCHANGED and is not written.
    """
    fields = [c for c in compared if c in existing.columns]
    image = F.struct(*fields)
    old = existing.select(F.col(key).alias("_key"), image.alias("_old"))
    seq = previous_row(incoming, [key], order, fields, "_prev", null_safe=True)
    joined = seq.join(old, seq[key].eqNullSafe(old["_key"]), "left").drop("_key")
    before = F.coalesce("_prev", "_old")
    status = (F.when(before.isNull(), "INSERTED").when(before.eqNullSafe(image), "UNCHANGED").otherwise("UPDATED"))
    judged = joined.withColumn("status", status).drop("_prev", "_old")
    cols = [c for c in existing.columns if c != key]
    written = (judged.filter("status <> 'UNCHANGED'").groupBy(key)
               .agg(F.max_by(F.struct(*[F.col(c) if c in judged.columns else F.lit(None).alias(c) for c in cols]),
                             F.col(order)).alias("_new")).withColumnRenamed(key, "_key"))
    merged = existing.join(written, existing[key].eqNullSafe(written["_key"]), "full_outer")
    keep = []
    for c in existing.columns:
        if c == key:
            keep.append(F.coalesce(existing[key], F.col("_key")).alias(c))
        elif c == "spec_id":
            keep.append(F.coalesce(existing[c], F.concat(F.lit("new-"), F.col("_key"))).alias(c))
        else:
            keep.append(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(existing[c]).alias(c))
    return merged.select(*keep), judged.select(key, order, "status")


def replace_specs(existing: DataFrame, incoming: DataFrame, order: str = "batch_ord", key: str = "slug") -> DataFrame:
    """Incoming rows win unconditionally, the last of a slug first of all."""
    cols = [c for c in existing.columns if c != key]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_new"))
    joined = existing.join(last, key, "full_outer")
    return joined.select(key, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
                                for c in cols])


# --- counts ------------------------------------------------------------------------------------------------------

def seed_summary(status: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    def n(value: str) -> Column:
        return F.count_if(F.col("status") == value)
    return status.groupBy(*keys).agg(
        F.count("*").alias("loaded"), n("INSERTED").alias("inserted"), n("UPDATED").alias("updated"),
        n("UNCHANGED").alias("unchanged"), n("FAILED").alias("failed")).withColumn(
        "total", F.col("inserted") + F.col("updated") + F.col("unchanged"))


def verify_catalog(specs: DataFrame, media: str) -> DataFrame:
    """One row of conditional counts.  Duplicates come from a count per slug, so the set of slugs is never in one task."""
    mine = F.col("media") == media
    per_slug = specs.groupBy("slug").agg(
        F.count("*").alias("n"), F.count_if(mine).alias("mine"),
        F.count_if(mine & (F.col("parse_status") == "parsed_text")).alias("parsed"),
        F.count_if(mine & (F.col("parse_status") == "diagram_unreadable")).alias("unreadable"),
        F.count_if(mine & F.coalesce("needs_review", F.lit(False))).alias("review"),
        F.count_if((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0)).alias("bad"))
    return per_slug.agg(
        F.sum("mine").alias("total"), F.sum("parsed").alias("parsed_text"), F.sum("unreadable").alias("diagram_unreadable"),
        F.sum("review").alias("needs_review"), F.sum(F.when(F.coalesce("slug", F.lit("")) == "", F.col("n")).otherwise(0)).alias("null_slug"),
        F.sum("bad").alias("bad_dims"), F.sum(F.when(F.col("slug").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_slugs"),
        (F.sum("n") - F.sum("mine")).alias("foreign_media"))


def deactivate(specs: DataFrame, media: str, slugs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Switches listed specs of a media off.  With more finds than the list is long (``limit``) it refuses: nothing changes.

    The second frame, one row, counts finds, those active at the start, those changed, and says whether it refused.
    """
    listed = specs.join(slugs.select("slug").distinct().withColumn("_hit", F.lit(True)), "slug", "left")
    hit = F.coalesce(F.col("_hit") & (F.col("media") == media), F.lit(False))
    counts = listed.agg(F.count_if(hit).alias("found"), F.count_if(hit & F.col("active")).alias("active_at_start"))
    counts = (counts.withColumn("refused", F.col("found") > limit)
              .withColumn("modified", F.when(F.col("refused"), F.lit(0)).otherwise(F.col("active_at_start"))))
    refused = counts.select("refused").scalar()
    off = listed.withColumn("active", F.when(hit & ~refused, False).otherwise(F.col("active"))).drop("_hit")
    return off, counts


def media_selection(specs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per media: number of specs, number chosen, all chosen, some chosen."""
    marked = specs.join(chosen.select("slug").distinct().withColumn("_on", F.lit(True)), "slug", "left")
    return marked.groupBy("media").agg(F.count("*").alias("specs"), F.count("_on").alias("selected")).withColumns(
        {"all_selected": (F.col("selected") == F.col("specs")),
         "partial": (F.col("selected") > 0) & (F.col("selected") < F.col("specs"))})


def spec_items(specs: DataFrame) -> DataFrame:
    """Request items: the stored inset map or one built from parsed insets, and the file rules when there are any."""
    rules = F.when(F.col("file_formats").isNotNull() | F.col("max_file_size_kb").isNotNull(), F.struct(
        "file_formats", "max_file_size_kb", "min_file_size_kb"))
    return specs.select("media", F.col("placement_name").alias("name"), F.coalesce("slug", F.lit("")).alias("slug"),
                        "width", "height", F.coalesce("safe_zone", inset_map()).alias("safe_zone"),
                        F.col("parse_status"), rules.alias("file_rules"))


# --- request resolution ------------------------------------------------------------------------------------------

def resolve_specs(messages: DataFrame, specs: DataFrame, first_of_media: bool = False) -> tuple[DataFrame, DataFrame]:
    """Specs of each job: its ids, or all active specs of its media when it names none; and the jobs left without.

    Jobs times specs of a media is as many rows as there are answers.  Who only asks which media a job has, and from where on,
    takes ``first_of_media``: of each media the active spec that is first in order stands for all.  The jobs left without are
    found by what is there at all, so no such row is made for them.
    """
    named = F.coalesce(F.size("spec_ids"), F.lit(0)) > 0
    ids = messages.filter(named).select("job_id", F.explode(F.array_distinct("spec_ids")).alias("slug"))
    media = messages.filter(~named).select("job_id", F.explode(F.array_distinct("target_media")).alias("media"))
    active = specs.filter("active")
    shelf = first_row(active.filter(F.col("media").isNotNull()), ["media"], [F.col("sort_order").isNull(), "sort_order"]) if first_of_media else active
    found = ids.join(specs, "slug").unionByName(media.join(shelf, "media"))
    served = (ids.join(specs.select("slug").distinct(), "slug", "left_semi").select("job_id")
              .union(media.join(active.select("media").distinct(), "media", "left_semi").select("job_id")))
    failed = messages.select("job_id").join(served, "job_id", "left_anti").withColumn("error", F.lit("no specs selected"))
    return found, failed


def job_media(found: DataFrame) -> DataFrame:
    """Distinct media per job in catalog order; at most one entry per media name."""
    first = found.groupBy("job_id", "media").agg(F.min("sort_order").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "media"))), lambda s: s["media"])
    return first.groupBy("job_id").agg(ordered.alias("media"))


def resolve_safe_zone(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """Insets per requested item: the catalog's when all four are known, else map, camel-case, snake-case value, 0.

    ``requests``: job_id, ordinal, slug, width, height, zone (map), and optional camel/snake columns ``safeTop`` …,
    ``safe_top`` ….  A blank slug is never looked up.
    """
    known = F.lit(True)
    for c in INSETS:
        known = known & F.col(c).isNotNull()
    catalog = (specs.filter(known & (F.coalesce("slug", F.lit("")) != "")).groupBy("slug")
               .agg(F.min_by(F.struct(*INSETS), "sort_order").alias("_db")))
    joined = requests.join(catalog, "slug", "left")
    out = {}
    for key, snake in zip(("top", "right", "bottom", "left"), INSETS):
        camel = "safe" + key.capitalize()
        sources = [F.try_element_at("zone", F.lit(key))]
        sources += [F.col(c) for c in (camel, snake) if c in requests.columns]
        out[f"zone_{key}"] = F.coalesce(F.col("_db")[snake], *sources, F.lit(0)).cast("int")
    return joined.withColumns({**out, "zone_source": F.when(F.col("_db").isNotNull(), "catalog").otherwise("request")}).drop("_db")

"""Layer trees of layered source files, kept as rows in depth-first order (``ord``, ``depth``)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adlattice import vocab
from adlattice.functions import geometry as G
from adlattice.functions.text import layer_role
from adlattice.operators.scale import first_row, running_max
from adlattice.session import materialise

MARGIN = 30


def fill_group_bboxes(layers: DataFrame, key: str = "psd_id") -> DataFrame:
    """Boxes of groups from the leaves below them.

    A leaf belongs to the group at level d if that group is the last row before it with depth ≤ d.  Each row is
    expanded to the levels above it (tree depth is small), the owner is a running maximum, and the hull a plain
    aggregate; no subtree is gathered.
    """
    deepest = F.sequence(F.lit(0), F.col("depth"))
    levels = layers.withColumn("_d", F.explode(deepest)).select(key, "ord", "depth", "is_group", "_d",
                                                                *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    # a row may close the level d only if its own depth ≤ d, i.e. at the expanded level d = depth; deeper levels are
    # closed too, so boundary rows are repeated for every level that occurs in the file
    depths = layers.groupBy(key).agg(F.max("depth").alias("_max"))
    bounds = (layers.join(depths, key).withColumn("_d", F.explode(F.sequence(F.col("depth"), F.col("_max"))))
              .select(key, "ord", "_d", F.col("ord").alias("_owner"), F.lit(True).alias("_bound")))
    inner = (levels.filter((F.col("_d") < F.col("depth")) & ~F.col("is_group"))
             .select(key, "ord", "_d", F.lit(None).cast("int").alias("_owner"), F.lit(False).alias("_bound"),
                     "x1", "y1", "x2", "y2"))
    both = inner.unionByName(bounds, allowMissingColumns=True)
    owned = running_max(both, [key, "_d"], "ord", F.col("_owner"), "_group").filter(~F.col("_bound"))
    hulls = (owned.groupBy(key, F.col("_group").alias("ord"), "_d")
             .agg(*[f(c).alias(f"_{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
             .withColumnRenamed("_d", "depth"))
    joined = layers.join(hulls, [key, "ord", "depth"], "left")
    return joined.withColumns({c: F.when(F.col("is_group"), F.col(f"_{c}")).otherwise(F.col(c))
                               for c in ("x1", "y1", "x2", "y2")}).drop("_x1", "_y1", "_x2", "_y2")


def layout_targets(layers: DataFrame) -> DataFrame:
    """Layers which take part in the reflow layouts."""
    hidden = F.col("role").isin("bg", "unknown") & ~F.lower("name").isin("model", "person")
    return layers.filter(F.col("visible") & F.col("x1").isNotNull() & ~F.col("name").isin(*vocab.BACKGROUND_PIXEL_NAMES)
                         & ~(F.col("is_group") & (F.col("role") != "badge")) & ~hidden)


def top_layers(layers: DataFrame) -> DataFrame:
    return layers.filter((F.col("depth") == 0) & (F.col("role") != "bg") & ~F.col("name").isin(*vocab.BACKGROUND_NAMES)
                         & F.col("visible"))


def expand_groups(layers: DataFrame, key: str = "psd_id") -> DataFrame:
    """Pieces a top layer is composited from: itself, its children, or a child group's own visible children.

    ``layers``: key, ord, depth, name, role, is_group, visible.  Parents are the last row of the level above (a running maximum); a child group with more than one meaningful
    child is replaced by these.
    """
    named = layers.withColumn("_bg", F.lower("name").isin(*vocab.BACKGROUND_NAMES))
    for level, out in ((0, "_top"), (1, "_child")):
        named = running_max(named, [key], "ord", F.when(F.col("depth") == level, F.col("ord")), out)
    # written once: tops, children and subs are all taken from it
    named = materialise(named.select(key, "ord", "depth", "name", "role", "is_group", "visible", "_bg", "_top", "_child"))
    tops = top_layers(named).select(key, F.col("ord").alias("_top"), F.col("is_group").alias("_tgroup"),
                                    F.col("role").alias("_trole"))
    single = tops.filter(~F.col("_tgroup")).select(key, F.col("_top").alias("ord"), F.lit("layer").alias("piece"),
                                                   F.col("_trole").alias("piece_role"))
    groups = tops.filter("_tgroup").drop("_tgroup")
    children = (named.filter((F.col("depth") == 1) & ~F.col("_bg")).drop("_child").join(groups, [key, "_top"])
                .select(key, F.col("ord").alias("_child"), "_top", "_trole", "role", F.col("is_group").alias("_cgroup")))
    subs = (named.filter((F.col("depth") == 2) & ~F.col("_bg") & F.col("visible")
                         & (F.col("_child") > F.col("_top")))
            .select(key, "ord", "_child", "role"))
    counts = subs.groupBy(key, "_child").agg(F.count("*").alias("_n"))
    sized = children.join(counts, [key, "_child"], "left")
    open_up = F.col("_cgroup") & (F.coalesce("_n", F.lit(0)) > 1)
    whole = sized.filter(~open_up).select(key, F.col("_child").alias("ord"), F.lit("child").alias("piece"),
                                          F.col("role").alias("piece_role"))
    parts = (subs.join(sized.filter(open_up).select(key, "_child"), [key, "_child"])
             .select(key, "ord", F.lit("sub").alias("piece"), F.col("role").alias("piece_role")))
    return single.unionByName(whole).unionByName(parts)


def first_by_role(layers: DataFrame, key: str = "psd_id") -> DataFrame:
    return first_row(layers, [key, "role"], ["ord"])


def detected_roles(layers: DataFrame, key: str = "psd_id") -> DataFrame:
    """Sorted role names per file; a set over the nine role words, hence small."""
    roles = F.sort_array(F.collect_set(F.when(F.col("role") != "unknown", F.col("role"))))
    return layers.groupBy(key).agg(F.array_join(roles, ",").alias("roles"))


def hull(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"),
                                    F.max("y2").alias("y2"))


def ap_layout(layers: DataFrame) -> DataFrame:
    """Uniform scale and centre offset; the far corner starts from the rounded near corner."""
    s = F.least(F.col("tgt_w") / F.col("src_w"), F.col("tgt_h") / F.col("src_h"))
    ox, oy = (F.col("tgt_w") - F.col("src_w") * s) / 2, (F.col("tgt_h") - F.col("src_h") * s) / 2
    near = layers.withColumns({"nx1": G.px_round(F.col("x1") * s + ox), "ny1": G.px_round(F.col("y1") * s + oy)})
    return near.withColumns({"nx2": G.px_round(F.col("nx1") + (F.col("x2") - F.col("x1")) * s),
                             "ny2": G.px_round(F.col("ny1") + (F.col("y2") - F.col("y1")) * s)})


def ap_place(layers: DataFrame) -> DataFrame:
    """Compositor's placement: truncated, not rounded; boxes without area are not placed."""
    s = F.least(F.col("tgt_w") / F.col("src_w"), F.col("tgt_h") / F.col("src_h"))
    ox, oy = (F.col("tgt_w") - F.col("src_w") * s) / 2, (F.col("tgt_h") - F.col("src_h") * s) / 2
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return layers.filter((w > 0) & (h > 0)).withColumns({
        "render_x": G.px_cut(F.col("x1") * s + ox), "render_y": G.px_cut(F.col("y1") * s + oy),
        "render_w": F.greatest(F.lit(1), G.px_cut(w * s)), "render_h": F.greatest(F.lit(1), G.px_cut(h * s))})


_BOX = "ord", "x1", "y1", "x2", "y2"


def _once(targets: DataFrame, key: str) -> DataFrame:
    """The targets written, as pivots and text blocks both come from them."""
    return materialise(targets.select(key, "ord", "role", "name", "is_group", "x1", "y1", "x2", "y2", "src_w", "src_h", "tgt_w", "tgt_h"))


def _pivots(targets: DataFrame, key: str) -> DataFrame:
    """First logo, product and model of a file and the hull of its text, in one aggregate."""
    image = F.struct(*_BOX)
    model = F.col("role").isin("person", "model") | F.col("name").isin("model", "person")

    def first(cond: Column) -> Column:
        return F.min_by(F.when(cond, image), F.when(cond, F.col("ord")))
    text = is_text()
    return targets.groupBy(key).agg(
        first(F.col("role") == "logo").alias("logo"), first(F.col("role") == "product").alias("prod"),
        first(model).alias("model"),
        *[f(F.when(text, F.col(c))).alias(f"t{c}")
          for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))],
        F.max("src_w").alias("src_w"), F.max("src_h").alias("src_h"), F.max("tgt_w").alias("tgt_w"),
        F.max("tgt_h").alias("tgt_h"))


def is_text() -> Column:
    return (F.col("role").isin("title", "body") & ~F.col("is_group")) | (F.col("role") == "badge")


def _slots(pivots: DataFrame, key: str, slots: dict[str, tuple]) -> DataFrame:
    """A row per pivot that a file has: ``slots`` gives its x1, y1, x2, y2 and scale.  All slots leave a file's row at once."""
    rows = [F.struct(F.col(which)["ord"].alias("ord"), F.lit(which).alias("slot"), *[
        c.alias(n) for n, c in zip(("nx1", "ny1", "nx2", "ny2", "scale_used"), cols)], F.col(which).isNotNull().alias("_there"))
        for which, cols in slots.items()]
    return pivots.select(key, F.inline(F.array(*rows))).filter("_there").drop("_there")


def edge_layout(targets: DataFrame, key: str = "psd_id", margin: int = MARGIN) -> DataFrame:
    """Wide strips: model at the right edge, product at the left, logo and text centred between them."""
    targets = _once(targets, key)
    p = _pivots(targets, key)
    s = F.least(F.lit(1.0), F.col("tgt_h") / F.col("src_h"))
    oy = (F.col("tgt_h") - F.col("src_h") * s) / 2
    m, q = F.col("model"), F.col("prod")
    mx1 = G.px_round(F.col("tgt_w") - (m["x2"] - m["x1"]) * s)
    my1 = G.px_round(m["y1"] * s + oy)
    ph = (q["y2"] - q["y1"]) * s
    py1 = G.px_round((F.col("tgt_h") - ph) / 2)
    px2 = G.px_round(margin + (q["x2"] - q["x1"]) * s)
    p = p.withColumns({"_s": s, "_mx1": mx1, "_my1": my1, "_my2": G.px_round(my1 + (m["y2"] - m["y1"]) * s),
                       "_py1": py1, "_px2": px2, "_py2": G.px_round(py1 + ph)})
    logo = F.col("logo")
    p = p.withColumns({
        "_right": F.coalesce("_mx1", F.col("tgt_w") - margin), "_left": F.coalesce(F.col("_px2") + margin, F.lit(margin)),
        "ux1": F.least("tx1", logo["x1"]), "uy1": F.least("ty1", logo["y1"]),
        "ux2": F.greatest("tx2", logo["x2"]), "uy2": F.greatest("ty2", logo["y2"])})
    room = F.greatest(F.lit(100), F.col("_right") - F.col("_left"))
    uw = (F.col("ux2") - F.col("ux1")) * F.col("_s")
    p = p.withColumn("_room", room).withColumn(
        "_ts", F.when(uw > F.col("_room"), F.col("_s") * (F.col("_room") / uw)).otherwise(F.col("_s")))
    p = p.withColumns({"_ox": F.col("_left") + (F.col("_room") - (F.col("ux2") - F.col("ux1")) * F.col("_ts")) / 2,
                       "_oy": (F.col("tgt_h") - (F.col("uy2") - F.col("uy1")) * F.col("_ts")) / 2})
    p = materialise(p)
    fixed = _slots(p, key, {"model": (F.col("_mx1"), F.col("_my1"), F.col("tgt_w"), F.col("_my2"), F.col("_s")),
                            "prod": (F.lit(margin), F.col("_py1"), F.col("_px2"), F.col("_py2"), F.col("_s"))})
    block = p.select(key, F.col("logo")["ord"].alias("_logo"), "ux1", "uy1", "_ts", "_ox", "_oy")
    middle = targets.select(key, "ord", "x1", "y1", "x2", "y2", is_text().alias("_t"), "role").filter(
        F.col("_t") | (F.col("role") == "logo")).join(block, key).filter(F.col("_t") | (F.col("ord") == F.col("_logo")))
    return fixed.unionByName(_spread(middle, key, F.when(F.col("_t"), "text").otherwise("logo")))


def _spread(block: DataFrame, key: str, slot: Column) -> DataFrame:
    near = block.withColumns({"nx1": G.px_round(F.col("_ox") + (F.col("x1") - F.col("ux1")) * F.col("_ts")),
                              "ny1": G.px_round(F.col("_oy") + (F.col("y1") - F.col("uy1")) * F.col("_ts"))})
    return near.select(key, "ord", slot.alias("slot"), "nx1", "ny1",
                       G.px_round(F.col("nx1") + (F.col("x2") - F.col("x1")) * F.col("_ts")).alias("nx2"),
                       G.px_round(F.col("ny1") + (F.col("y2") - F.col("y1")) * F.col("_ts")).alias("ny2"),
                       F.col("_ts").alias("scale_used"))


def vertical_layout(targets: DataFrame, key: str = "psd_id", margin: int = MARGIN) -> DataFrame:
    """Tall strips: product and logo from the top, text hull at the bottom, model filling what is left."""
    targets = _once(targets, key)
    p = _pivots(targets, key)
    inner = F.col("tgt_w") - 2 * margin
    p = p.withColumn("_s", F.greatest(F.lit(0.4), F.least(F.lit(1.0), inner / F.col("src_w"))))

    def centred(box: Column, scale: Column, top: Column, tag: str) -> dict[str, Column]:
        w, h = (box["x2"] - box["x1"]) * scale, (box["y2"] - box["y1"]) * scale
        x1 = G.px_round((F.col("tgt_w") - w) / 2)
        return {f"_{tag}x1": x1, f"_{tag}y1": top, f"_{tag}x2": G.px_round(x1 + w), f"_{tag}y2": G.px_round(top + h)}
    p = p.withColumns(centred(F.col("prod"), F.col("_s"), F.lit(margin), "p"))
    p = p.withColumn("_top", F.coalesce(F.col("_py2") + margin // 2, F.lit(margin)))
    p = p.withColumns(centred(F.col("logo"), F.col("_s"), F.col("_top"), "l"))
    p = p.withColumn("_top2", F.coalesce(F.col("_ly2") + margin, F.col("_top")))
    tw, th = F.col("tx2") - F.col("tx1"), F.col("ty2") - F.col("ty1")
    p = p.withColumn("_ts", F.when(tw * F.col("_s") > inner, inner / tw).otherwise(F.col("_s")))
    p = p.withColumns({"_oy": F.col("tgt_h") - margin - th * F.col("_ts"),
                       "_ox": (F.col("tgt_w") - tw * F.col("_ts")) / 2})
    p = p.withColumn("_bottom", F.coalesce(G.px_round("_oy") - margin, F.col("tgt_h") - margin))
    model = F.col("model")
    p = p.withColumn("_fill", F.greatest(F.lit(100), F.col("_bottom") - F.col("_top2")) / (model["y2"] - model["y1"]))
    p = p.withColumns(centred(model, F.col("_fill"), F.col("_top2"), "m"))
    p = materialise(p)
    out = _slots(p, key, {which: tuple(F.col(f"_{tag}{c}") for c in ("x1", "y1", "x2", "y2")) + (F.col(scale),)
                          for which, tag, scale in (("prod", "p", "_s"), ("logo", "l", "_s"), ("model", "m", "_fill"))})
    block = p.select(key, F.col("tx1").alias("ux1"), F.col("ty1").alias("uy1"), "_ts", "_ox", "_oy")
    text = targets.filter(is_text()).select(key, "ord", "x1", "y1", "x2", "y2").join(block, key)
    return out.unionByName(_spread(text, key, F.lit("text")))


def merge_layers(layers: DataFrame, placed: DataFrame, key: str = "psd_id") -> DataFrame:
    """Layers with their rendered box, matched on the bare name; the last placement of a name wins."""
    last = first_row(placed.select(key, F.col("name").alias("_name"), "ord", "render_x", "render_y", "render_w",
                                   "render_h"), [key, "_name"], ["ord"], desc_last=True).drop("ord")
    bare = layers.withColumn("_name", bare_name(F.col("name")))
    return bare.join(last, [key, "_name"], "left").drop("_name")


def bare_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^[\[\] \t]+|[\[\] \t]+$", "")


def apply_edits(layout: DataFrame, edits: DataFrame, key: str = "psd_id") -> DataFrame:
    """Stored layout rows with the user's last edit per name; absent values keep the stored ones."""
    fields = ["render_x", "render_y", "render_w", "render_h"]
    last = first_row(edits.select(key, "name", "edit_no", *fields), [key, "name"], ["edit_no"], desc_last=True)
    renamed = last.select(key, "name", *[F.col(f).alias(f"_{f}") for f in fields])
    return layout.join(renamed, [key, "name"], "left").withColumns(
        {f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def placement_roles(layout: DataFrame, layers: DataFrame, key: str = "psd_id") -> DataFrame:
    """Placed boxes with the role of their name (last layer of the name wins); y is not negative, x may be.

    A placement is found again by name and depth: the first such layer, which must have an area.
    """
    roles = first_row(layers.select(key, "name", "ord", F.col("role").alias("role_by_name")), [key, "name"], ["ord"],
                      desc_last=True).drop("ord")
    source = first_row(layers.select(key, "name", "depth", "ord", "x1", "y1", "x2", "y2"), [key, "name", "depth"],
                       ["ord"]).filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    last = first_row(layout.select(key, "name", "depth", "ord", "nx1", "ny1", "nx2", "ny2"), [key, "name", "depth"],
                     ["ord"], desc_last=True)
    joined = last.join(source.select(key, "name", "depth"), [key, "name", "depth"]).join(roles, [key, "name"], "left")
    return joined.select(
        key, bare_name(F.col("name")).alias("name"), "depth", F.col("nx1").alias("render_x"),
        F.greatest(F.lit(0), F.col("ny1")).alias("render_y"),
        F.greatest(F.lit(1), F.col("nx2") - F.col("nx1")).alias("render_w"),
        F.greatest(F.lit(1), F.col("ny2") - F.col("ny1")).alias("render_h"),
        F.coalesce("role_by_name", F.lit("unknown")).alias("role"))


def with_role(layers: DataFrame) -> DataFrame:
    return layers.withColumn("role", layer_role(F.col("name")))

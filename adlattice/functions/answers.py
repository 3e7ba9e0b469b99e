"""Typed rows from untrusted JSON answers: everything wrong-typed becomes a default, nothing raises.

The schemas are typed: a field of the wrong JSON type reads as null on its own (a quoted number is not a number),
so one wrong field never spoils its object.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlattice import vocab

BOX = "struct<x:double,y:double,width:double,height:double>"
ANALYSIS = (
    "creativeType string, textDensity string, edgeRisk string, mainSubjectPosition string, resizeMode string, "
    "smartFitStrength string, focalPosition string, layoutType string, reflowRecommended string, confidence double, "
    "reason string, warnings array<string>, detectedElements string, elementGroups string, contentBands string")
ELEMENTS = f"array<struct<id:string,type:string,label:string,group:string,importance:string,bbox:{BOX}>>"
GROUP_LIST = "array<struct<id:string,name:string,importance:string,elementIds:array<string>>>"
BANDS = ("array<struct<id:string,name:string,role:string,y1:double,y2:double,importance:string,reflowPriority:string,"
         "canDrop:boolean,canCrop:boolean,targetPlacement:string>>")
OBJECTS = (f"array<struct<id:string,role:string,label:string,importance:string,bbox:{BOX},confidence:double,"
           "reflowBehavior:string,safeZoneRequired:boolean,canScale:boolean,canCrop:boolean,recommendedLayerName:string,"
           "matchedLayerId:string,matchedLayerName:string,matchScore:double,matchStatus:string>>")
SCENE = (f"array<struct<id:string,role:string,required:boolean,movable:boolean,removableFromScene:boolean,bbox:{BOX},"
         "polygon:array<array<int>>,confidence:double,groupId:string,zIndex:double,textContent:string,description:string>>")
VALIDATION = ("adObjectsRemaining boolean, remainingObjectIds array<string>, protectedSubjectPreserved boolean, "
              "visibleSeamDetected boolean, newlyGeneratedTextDetected boolean, sceneNaturalnessScore double")
COMPARE = ("bestCandidate string, summary string, candidates array<struct<strength:string,score:double,"
           "pros:array<string>,cons:array<string>,preservedRequiredGroups:array<string>,"
           "lostRequiredGroups:array<string>>>")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row: a nested expression that is named several times would
    otherwise be parsed as often."""
    return F.transform(F.array(value), use)[0]


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def whole(value: Column, default: int | None = 0) -> Column:
    n = value.cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def flag(value: Column, default: bool) -> Column:
    return F.coalesce(value, F.lit(default))


def text(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def box(raw: Column) -> Column:
    return F.when(raw.isNotNull(), F.struct(whole(raw["x"]).alias("x"), whole(raw["y"]).alias("y"),
                                            whole(raw["width"]).alias("w"), whole(raw["height"]).alias("h")))


def word_list(raw: Column) -> Column:
    return F.coalesce(raw, F.array().cast("array<string>"))


# --- code fences -------------------------------------------------------------------------------------------------

def strip_fence(raw: Column) -> Column:
    """Pattern variant: opening fence with its language word and the closing fence go."""
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")

    def inner(t: Column) -> Column:
        return bare(F.regexp_replace(F.regexp_replace(t, r"(?s)^```[a-zA-Z]*\s*", ""), r"(?s)```\s*$", ""))
    return once(bare(raw), lambda t: F.when(t.startswith("```"), inner(t)).otherwise(t))


def json_start(raw: Column) -> Column:
    """The stripped text if it begins like JSON, else null (blank and chatty answers alike)."""
    return once(strip_fence(raw), lambda t: F.when(t.startswith("{") | t.startswith("["), t))


def strip_fence_lines(raw: Column) -> Column:
    """Line variant: the first line and all closing fence lines go."""
    def body(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n?", ""), r"(\n?[ \t]*```[ \t]*)+$", "")
    return once(F.regexp_replace(raw, r"^\s+|\s+$", ""), lambda t: F.when(t.startswith("```"), body(t)).otherwise(t))


# --- answers -----------------------------------------------------------------------------------------------------

def read_analysis(raw: Column) -> Column:
    """The typed fields of an analysis as they stand, its three lists still as text."""
    return F.from_json(raw, ANALYSIS)


def parse_analysis(raw: Column) -> Column:
    return once(read_analysis(raw), lambda r: F.struct(*[c.alias(name) for name, c in analysis(r).items()]))


def analysis(r: Column) -> dict[str, Column]:
    """The row of what ``read_analysis`` gave, by field.  As columns of a frame they are pruned: who selects some gets only these
    computed, and the three lists, a parse each, are read only where they are wanted."""
    return {
        "creative_type": one_of(r["creativeType"], vocab.CREATIVE_TYPES, "balanced_mix"),
        "text_density": one_of(r["textDensity"], vocab.DENSITIES, "medium"),
        "edge_risk": one_of(r["edgeRisk"], vocab.DENSITIES, "medium"),
        "subject_position": one_of(r["mainSubjectPosition"], vocab.FOCAL_POSITIONS, "center"),
        "resize_mode": one_of(r["resizeMode"], vocab.RESIZE_MODES, "smart-fit"),
        "strength": one_of(r["smartFitStrength"], vocab.STRENGTHS, "balanced"),
        "focal_position": one_of(r["focalPosition"], vocab.FOCAL_POSITIONS, "center"),
        "layout_type": one_of(r["layoutType"], vocab.LAYOUT_TYPES, "single_subject"),
        "reflow_recommended": F.coalesce(F.lower(r["reflowRecommended"]) == "true", F.lit(False)),
        "confidence": r["confidence"], "reason": text(r["reason"]), "warnings": word_list(r["warnings"]),
        "elements": parse_elements(r["detectedElements"]), "groups": parse_groups(r["elementGroups"]),
        "bands": parse_bands(r["contentBands"])}


def _items(raw: Column, schema: str) -> Column:
    return once(raw, lambda r: F.when(r.startswith("["), F.from_json(r, schema)))


def parse_elements(raw: Column) -> Column:
    return F.transform(_items(raw, ELEMENTS), lambda e: F.struct(
        text(e["id"]).alias("id"), one_of(e["type"], vocab.ELEMENT_TYPES, "decoration").alias("type"),
        text(e["label"]).alias("label"), one_of(e["group"], vocab.GROUPS, "decorations").alias("group"),
        one_of(e["importance"], vocab.IMPORTANCES, "optional").alias("importance"), box(e["bbox"]).alias("bbox")))


def parse_groups(raw: Column) -> Column:
    return F.transform(_items(raw, GROUP_LIST), lambda g: F.struct(
        text(g["id"]).alias("id"), text(g["name"]).alias("name"),
        one_of(g["importance"], vocab.IMPORTANCES, "optional").alias("importance"),
        F.coalesce(g["elementIds"], F.array().cast("array<string>")).alias("element_ids")))


def parse_bands(raw: Column) -> Column:
    """Bands with numeric edges in rising order; the rest are dropped."""
    typed = F.transform(_items(raw, BANDS), lambda b: F.struct(
        text(b["id"]).alias("id"), text(b["name"]).alias("name"),
        one_of(b["role"], vocab.BAND_ROLES, "description").alias("role"), whole(b["y1"], None).alias("y1"),
        whole(b["y2"], None).alias("y2"), one_of(b["importance"], vocab.IMPORTANCES, "priority").alias("importance"),
        one_of(b["reflowPriority"], vocab.REFLOW_PRIORITIES, "support").alias("reflow_priority"),
        flag(b["canDrop"], False).alias("can_drop"), flag(b["canCrop"], False).alias("can_crop"),
        one_of(b["targetPlacement"], vocab.TARGET_PLACEMENTS, "center").alias("target_placement")))
    return F.filter(typed, lambda b: F.coalesce(b["y2"] > b["y1"], F.lit(False)))


def normalise_role(raw: Column) -> Column:
    """Synonyms to the role they mean, then the allow-list; anything else is unknown."""
    def known(d: Column) -> Column:
        out = None
        for role, words in vocab.ROLE_SYNONYMS.items():
            out = F.when(d["key"].isin(*words), role) if out is None else out.when(d["key"].isin(*words), role)
        return out.otherwise(d["raw"])
    named = once(F.struct(F.trim(F.lower(raw)).alias("key"), raw.alias("raw")), known)
    return once(named, lambda v: one_of(v, vocab.OBJECT_ROLES, "unknown"))


def parse_objects(raw: Column) -> Column:
    """Object list of a raw (possibly fenced) answer ``{"objects": [...]}``; empty when unusable."""
    listed = F.from_json(json_start(raw), f"objects {OBJECTS}")["objects"]
    return F.transform(F.coalesce(listed, F.array().cast(OBJECTS)), lambda o: F.struct(
        text(o["id"]).alias("id"), normalise_role(text(o["role"], "unknown")).alias("role"), text(o["label"]).alias("label"),
        one_of(o["importance"], vocab.IMPORTANCES, "optional").alias("importance"), box(o["bbox"]).alias("bbox"),
        o["confidence"].alias("confidence"),
        one_of(o["reflowBehavior"], vocab.REFLOW_BEHAVIORS, "keep_aspect").alias("reflow_behavior"),
        flag(o["safeZoneRequired"], False).alias("safe_zone_required"), flag(o["canScale"], True).alias("can_scale"),
        flag(o["canCrop"], False).alias("can_crop"), o["recommendedLayerName"].alias("recommended_layer"),
        o["matchedLayerId"].alias("matched_layer_id"), o["matchedLayerName"].alias("matched_layer"),
        o["matchScore"].alias("match_score"), text(o["matchStatus"], "missing_layer").alias("match_status")))


def build_manifest(raw: Column) -> Column:
    """Struct error, objects of a scene answer.  Missing fields get defaults that use the object's position."""
    def objects(listed: Column) -> Column:
        return F.transform(F.coalesce(_items(listed, SCENE), F.array().cast(SCENE)), lambda o, i: F.struct(
            F.coalesce(o["id"], F.concat(F.lit("obj_"), i.cast("string"))).alias("id"),
            text(o["role"], "decorative_ad").alias("role"), flag(o["required"], False).alias("required"),
            flag(o["movable"], True).alias("movable"), flag(o["removableFromScene"], True).alias("removable"),
            whole(o["bbox"]["x"]).alias("x"), whole(o["bbox"]["y"]).alias("y"), whole(o["bbox"]["width"]).alias("w"),
            whole(o["bbox"]["height"]).alias("h"),
            F.coalesce(o["polygon"], F.array().cast("array<array<int>>")).alias("polygon"),
            F.coalesce(o["confidence"], F.lit(0.5)).alias("confidence"),
            F.nullif(o["groupId"], F.lit("")).alias("group_id"), F.coalesce(whole(o["zIndex"], None), i).alias("z_index"),
            text(o["textContent"]).alias("text_content"), text(o["description"]).alias("description")))

    def build(doc: Column) -> Column:
        listed = doc["listed"]
        error = F.when(~doc["is_json"], "JSON_PARSE_FAILED").when(listed.isNotNull() & ~listed.startswith("["), "OBJECTS_NOT_A_LIST")
        return F.struct(error.alias("error"), F.when(error.isNull(), objects(listed)).alias("objects"))
    read = once(strip_fence_lines(raw), lambda t: F.struct(F.get_json_object(t, "$.objects").alias("listed"),
                                                           F.try_parse_json(t).isNotNull().alias("is_json")))
    return once(read, build)


def parse_validation(raw: Column) -> Column:
    read = once(strip_fence_lines(raw), lambda t: F.struct(F.from_json(t, VALIDATION).alias("r"), F.try_parse_json(t).isNull().alias("bad")))
    return once(read, lambda d: _verdict(d["r"], d["bad"]))


def _verdict(r: Column, bad: Column) -> Column:
    return F.struct(
        F.when(bad, "AI_RESPONSE_PARSE_FAILED").alias("error"), flag(r["adObjectsRemaining"], False).alias("ad_objects_remaining"),
        F.coalesce(r["remainingObjectIds"], F.array().cast("array<string>")).alias("remaining_ids"),
        flag(r["protectedSubjectPreserved"], True).alias("protected_preserved"),
        flag(r["visibleSeamDetected"], False).alias("visible_seam"),
        flag(r["newlyGeneratedTextDetected"], False).alias("new_text"),
        F.coalesce(r["sceneNaturalnessScore"], F.lit(1.0)).alias("naturalness"))


def parse_compare(raw: Column) -> Column:
    return once(F.from_json(raw, COMPARE), lambda r: F.struct(
        one_of(F.coalesce(r["bestCandidate"], F.lit("balanced")), vocab.COMPARE_CANDIDATES, "balanced").alias("best"),
        text(r["summary"]).alias("summary"),
        F.transform(r["candidates"], lambda c: F.struct(
            c["strength"].alias("strength"), whole(c["score"]).alias("score"), word_list(c["pros"]).alias("pros"),
            word_list(c["cons"]).alias("cons"), word_list(c["preservedRequiredGroups"]).alias("preserved_required"),
            word_list(c["lostRequiredGroups"]).alias("lost_required"))).alias("candidates")))


def error_code(body: Column) -> Column:
    """Code of an error body, else its type, else ``unknown``."""
    return F.coalesce(F.get_json_object(body, "$.error.code"), F.get_json_object(body, "$.error.type"), F.lit("unknown"))

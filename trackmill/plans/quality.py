"""Quality checks of annotation datasets: every rule is a DataFrame of findings.

A finding is (severity, kind, group, ord, n, details): details are what names the row, as JSON. The findings of all rules are one union; counts, bounded
examples and the report are small aggregates of it. Two profiles: ``protocol-aware`` passes over what
training would drop or what the reference dataset already had, ``strict-raw`` does not.
"""

from __future__ import annotations

import json
import math
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions.boxes import Box, close, displacement, iou_or_zero, overshoot, overshoot_limit, ratio_of_larger
from trackmill.operators.joins import identity_diff, overlaid
from trackmill.sources.annotations import Dataset

GROUPS = ("schema", "reference", "bbox", "duplicate", "track_category", "identity", "anchor", "leakage", "split_overlap")
PROFILES = ("protocol-aware", "strict-raw")
SPLITS = ("unspecified", "base-only", "base+novel", "validation")
FINDING = "severity string, kind string, group string, ord long, n long, details string"
#: What names a row, as far as it has it.
DETAILS = ("section", "id", "name", "file_name", "video_id", "image_id", "track_id", "category_id", "frame_index", "i_frame_index", "bbox", "outcome", "changed")
#: Earlier spellings of kinds, under which a report can be asked too.
ALIASES = {"new_category_identity": "new_categorie_identity", "category_identity_modified": "categorie_identity_modified"}
#: Annotations that a task holds in memory for the windows over them, about.
PART_ROWS = 100_000
ANCHOR = ["video_id", "frame_key", "track_id", "category_id"]
#: Temporal screens and their thresholds.
THRESHOLDS = {
    "track_length_anomaly": 2,
    "temporal_gap": 1,
    "track_reappearance": 10,
    "low_iou": 0.1,
    "center_displacement": 2.0,
    "box_size_jump": 4.0,
    "aspect_ratio_jump": 3.0,
    "identical_bbox_run": 5,
    "visibility_jump": 0.75,
}


def details(df: DataFrame) -> Column:
    held = [c for c in DETAILS if c in df.columns]
    return F.to_json(F.struct(*held)) if held else F.lit(None).cast("string")


def found(df: DataFrame, kind: str | Column, group: str, severity: str = "error", n: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    n = F.lit(1) if n is None else n
    return df.select(F.lit(severity).alias("severity"), kind.alias("kind"), F.lit(group).alias("group"), F.col("ord").cast("long"), n.cast("long").alias("n"), details(df).alias("details"))


def flagged(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Findings of many row rules in one pass: (condition, kind, group[, severity]) each."""
    hit = lambda cond, kind, group, severity="error": F.when(
        cond if isinstance(cond, Column) else F.expr(cond), F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.lit(group).alias("group"))
    )
    held = [c for c in DETAILS if c in df.columns]
    hits = df.select(F.col("ord").cast("long").alias("ord"), *held, F.explode(F.array_compact(F.array(*[hit(*r) for r in rules]))).alias("f"))
    return hits.select("f.severity", "f.kind", "f.group", "ord", F.lit(1).cast("long").alias("n"), details(hits).alias("details"))


def later(keys: list[str], among: Column | None = None) -> Column:
    """Whether a row repeats the keys of one before it by ord, among the rows of a condition.

    All other rows are spread by ord, however many of them share keys such as null."""
    if among is None:
        return F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) > 1
    apart = F.when(among, F.lit(None)).otherwise(F.col("ord"))
    return F.coalesce(among, F.lit(False)) & (F.row_number().over(Window.partitionBy(*keys, among, apart).orderBy("ord")) > 1)


def keyed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select("id", *[F.col(c).alias(prefix + c) for c in columns]).withColumn(f"{prefix}there", F.lit(True))


def bbox(df_prefix: str = "") -> Box:
    b = F.col(df_prefix + "bbox")
    return Box.xywh(b[0], b[1], b[2], b[3])


class Checks:
    """The findings of a dataset, against a reference, a split and a validation set where given."""

    def __init__(
        self,
        current: Dataset,
        reference: Dataset | None = None,
        full_reference: Dataset | None = None,
        profile: str = "protocol-aware",
        split: str = "unspecified",
        split_pairs: list[tuple[str, bool]] | None = None,
        split_issues: dict[str, int] | None = None,
        manifest: list[tuple[str, str, str, str, str]] | None = None,
        manifest_issues: dict[str, int] | None = None,
        validation: Dataset | None = None,
        training: dict | None = None,
        verbose: bool = False,
        tolerance: float = 1e-4,
        area_tolerance: float = 1e-4,
    ):
        if profile not in PROFILES or split not in SPLITS:
            raise ValueError(f"profile must be one of {PROFILES} and split one of {SPLITS}")
        self.spark = current.rows.sparkSession
        self.current, self.reference, self.full = current, reference, full_reference or reference
        self.strict, self.split, self.verbose = profile == "strict-raw", split, verbose
        self.split_pairs, self.split_issues = split_pairs, split_issues or {}
        self.manifest, self.manifest_issues = manifest or [], manifest_issues or {}
        self.validation, self.training = validation, training or {}
        self.tolerance, self.area_tolerance = tolerance, area_tolerance
        self.index = {s: current.index(s) for s in ("videos", "images", "tracks", "categories", "annotations")}

    # --- rules ----------------------------------------------------------------------------------

    def schema(self) -> list[DataFrame]:
        out = []
        for data, name in ((self.current, ""), (self.reference, "original_"), *([(self.full, "full_")] if self.full is not self.reference else [])):
            if data is None:
                continue
            shape = data.issues().withColumn("ord", F.lit(None).cast("long"))
            own = shape if not name else shape.filter("kind IN ('top_level_not_array', 'record_not_object')")
            out.append(found(own, F.col("kind"), "schema", n=F.coalesce("n", F.lit(1))))
            rows = data.rows.filter(F.col("section") != "$issue")
            annotation = (F.col("section") == "annotations") & F.lit(not name)
            sized, image = F.col("section").isin("videos", "images") & F.lit(not name), (F.col("section") == "images") & F.lit(not name)
            rules = [
                (~F.col("id_ok") & annotation, "annotation_id_missing_or_invalid", "schema"),
                (~F.col("id_ok") & ~annotation, "id_missing_or_invalid", "schema"),
                (F.col("_again"), "duplicate_id", "schema"),
                *[(sized & (F.col(c).isNull() | (F.col(c) <= 0)), "invalid_dimension", "schema") for c in ("width", "height")],
                (image & ~F.col("frame_ok"), "invalid_frame_index", "schema"),
                (image & F.col("has_frame_id") & ~F.col("frame_id_ok"), "invalid_frame_id", "schema"),
            ]
            out.append(flagged(rows.withColumn("_again", later(["section", "id"], F.col("id_ok"))), rules))
        return out

    def _with(self, df: DataFrame, section: str, key: str, columns: list[str]) -> DataFrame:
        """df with its row of a section's index, under the section's letter; x_there tells if it is there."""
        p = section[0] + "_"
        dim = keyed(self.index[section], p, columns).withColumnRenamed("id", key)
        return df.join(dim, key, "left").withColumn(p + "there", F.coalesce(p + "there", F.lit(False)))

    def references(self) -> list[DataFrame]:
        images = self._with(self.current.section("images"), "videos", "video_id", ["name", "length"])
        images = images.withColumn("_again", later(["video_id", "frame_index"], F.col("frame_ok") & F.col("v_there")))
        tracks = self._with(self._with(self.current.section("tracks"), "videos", "video_id", []), "categories", "category_id", [])
        return [
            flagged(
                images,
                [
                    ("NOT v_there", "image_video_reference_missing", "reference"),
                    ("v_there AND video IS NOT NULL AND v_name IS NOT NULL AND video <> v_name", "image_video_name_mismatch", "reference"),
                    ("frame_ok AND v_there AND frame_index >= v_length", "frame_outside_video_length", "reference"),
                    ("_again", "duplicate_video_frame", "duplicate"),
                ],
            ),
            flagged(tracks, [("NOT v_there", "track_video_reference_missing", "reference"), ("NOT c_there", "track_category_reference_missing", "reference")]),
        ]

    def linked(self) -> DataFrame:
        """All annotations with what they refer to."""
        a = self.current.section("annotations")
        a = self._with(a, "images", "image_id", ["video_id", "frame_index", "frame_key", "width", "height"])
        a = self._with(self._with(a, "videos", "video_id", []), "categories", "category_id", [])
        # last, so that its parts also serve windows over tracks
        return self._with(a.repartition(self.parts, "track_id"), "tracks", "track_id", ["video_id", "category_id"])

    @cached_property
    def parts(self) -> int:
        """Parts of about PART_ROWS annotations, so that a task's memory does not grow with the dataset."""
        return max(8, -(-self.current.section("annotations").count() // PART_ROWS))

    def annotations(self) -> list[DataFrame]:
        """All rules on single annotations, in one pass over them."""
        a = self.linked()
        first, framed = Window.partitionBy("track_id").orderBy("ord"), F.col("i_frame_index").isNotNull()
        a = a.withColumns({f"_{c}": F.first_value(c).over(first) for c in ("video_id", "category_id")})
        a = a.withColumns(
            {
                # the last whole frame of the track before this row
                "_before": F.last("i_frame_index", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, -1)),
                "_same_image": later(["track_id", "image_id"]),
                "_same_frame": later(["track_id", "i_frame_index"], framed),
            }
        )
        box = ["image_id", "video_id", "track_id", "category_id", "bbox"]
        a = a.repartition(self.parts, *box[:-1]).withColumn("_same_row", later(box, F.col("bbox_ok")))
        unsorted = ("track_frames_not_strictly_sorted", "track_category", "error") if self.strict else ("annotations_not_sorted_in_json", "track_category", "info")
        rules = [
            *[(f"NOT {letter}_there", f"annotation_{section}_reference_missing", "reference") for section, letter in (("image", "i"), ("video", "v"), ("category", "c"), ("track", "t"))],
            ("i_there AND NOT video_id <=> i_video_id", "annotation_image_video_mismatch", "reference"),
            ("t_there AND NOT video_id <=> t_video_id", "annotation_track_video_mismatch", "track_category"),
            ("t_there AND NOT category_id <=> t_category_id", "annotation_track_category_mismatch", "track_category"),
            ("NOT video_id <=> _video_id", "track_video_changed", "track_category"),
            ("NOT category_id <=> _category_id", "track_category_changed", "track_category"),
            ("i_frame_index <= _before", *unsorted),
            ("_same_image", "multiple_boxes_same_track_image", "duplicate"),
            ("_same_frame", "duplicate_track_frame", "duplicate"),
            ("_same_row", "duplicate_annotation", "duplicate"),
        ]
        a, more = self._box_rules(a)
        return [flagged(a, rules + more)]

    def anchors_of(self, annotations: DataFrame, images: DataFrame) -> DataFrame:
        """Indexed annotations with their frame, those that have one."""
        frames = images.select(F.col("id").alias("image_id"), "frame_key", F.col("frame_index").alias("i_frame_index"))
        return annotations.drop("frame_key").join(frames, "image_id").filter("frame_key IS NOT NULL")

    def reference_images(self) -> DataFrame:
        base = self.reference.index("images")
        return base if self.full is self.reference else overlaid(base, self.full.index("images"))

    def identity(self) -> list[DataFrame]:
        if self.reference is None:
            return []
        out = []
        for section, one, fields in (("videos", "video", ["name"]), ("categories", "category", ["name", "synset"]), ("tracks", "track", ["video_id", "category_id"])):
            diff = identity_diff(self.full.index(section), self.index[section], fields).withColumn("ord", F.lit(None).cast("long"))
            kind = F.when(F.col("outcome") == "new", f"new_{one}_identity").otherwise(f"{one}_identity_modified")
            out.append(found(diff, kind, "identity"))
        return out

    def anchor_outcomes(self) -> DataFrame | None:
        """(outcome, changed, image_moved, id_moved, on_new_track) of every anchor of either dataset."""
        if self.reference is None:
            return None
        near = lambda: F.coalesce(F.col("r_ok") & F.col("bbox_ok") & self._boxes_close("r_bbox", "bbox"), F.lit(False))
        known = self.full.index("tracks").select(F.col("id").alias("track_id"), F.lit(True).alias("known")).distinct()
        on_new = F.col("known").isNull()
        if self.strict:
            current = self.index["annotations"].join(self.index["images"].select(F.col("id").alias("image_id"), F.col("frame_index").alias("i_frame")), "image_id", "left")
            old = self.reference.index("annotations").join(self.reference_images().select(F.col("id").alias("image_id"), F.col("frame_index").alias("i_frame")), "image_id", "left")
            fields = ["image_id", "video_id", "track_id", "category_id", "i_frame"]
            old = old.select("id", *[F.col(c).alias("r_" + c) for c in fields], F.col("bbox").alias("r_bbox"), F.col("bbox_ok").alias("r_ok"), F.lit(True).alias("in_r"))
            both = current.withColumn("in_c", F.lit(True)).join(old, "id", "full_outer")
            differs = {("frame_index" if c == "i_frame" else c): ~F.col(c).eqNullSafe(F.col("r_" + c)) for c in fields} | {"bbox": ~near()}
            listed, moved = F.lit(None), (F.lit(False), F.lit(False))
        else:
            current = repeats_first(self.anchors_of(self.index["annotations"], self.index["images"]), ANCHOR)
            old = repeats_first(self.anchors_of(self.reference.index("annotations"), self.reference_images()), ANCHOR)
            old = old.select(*[F.col(c).alias("r_" + c) for c in (*ANCHOR, "image_id", "id")], F.col("bbox").alias("r_bbox"), F.col("bbox_ok").alias("r_ok"), F.lit(True).alias("in_r"), F.struct(*ANCHOR).alias("k"))
            both = current.withColumn("in_c", F.lit(True)).withColumn("k", F.struct(*ANCHOR)).join(old, "k", "full_outer")
            manifest = self.spark.createDataFrame([(r[:4],) for r in self.manifest], "m struct<video_id: string, frame_key: string, track_id: string, category_id: string>").distinct()
            both = both.join(F.broadcast(manifest), F.col("k") == F.col("m"), "left")
            differs = {"bbox": ~near()}
            listed, moved = F.col("m"), (~F.col("image_id").eqNullSafe(F.col("r_image_id")), ~F.col("id").eqNullSafe(F.col("r_id")))
        changed = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]))
        outcome = F.when(F.col("in_r").isNull(), "added").when(F.col("in_c").isNull(), F.when(listed.isNotNull(), "filtered").otherwise("missing"))
        outcome = outcome.when(F.size(changed) > 0, "modified").otherwise("preserved")
        both = both.join(known, "track_id", "left")
        return both.select("ord", outcome.alias("outcome"), F.when(outcome == "modified", changed).alias("changed"), moved[0].alias("image_moved"), moved[1].alias("id_moved"), on_new.alias("on_new_track"))

    def _boxes_close(self, a: str, b: str) -> Column:
        return F.forall(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: F.abs(p["x"] - p["y"]) <= self.tolerance)

    def added_on_new_tracks(self) -> DataFrame:
        """Annotations (not only anchors) that the reference does not have, on tracks it does not have."""
        known = self.full.index("tracks").select(F.col("id").alias("track_id"))
        if self.strict:
            added = self.index["annotations"].join(self.reference.index("annotations").select("id"), "id", "left_anti")
        else:
            key = F.struct(*ANCHOR).alias("k")
            old = self.anchors_of(self.reference.index("annotations"), self.reference_images()).select(key).distinct()
            added = self.anchors_of(self.index["annotations"], self.index["images"]).withColumn("k", key).join(old, "k", "left_anti")
        return added.join(known, "track_id", "left_anti")

    def anchors(self) -> list[DataFrame]:
        again = lambda df: flagged(df.withColumn("_again", later(ANCHOR)), [("_again", "duplicate_semantic_anchor_key", "duplicate")])
        out = [again(self.anchors_of(self.index["annotations"], self.index["images"])), self._counted(self.manifest_issues, "anchor")]
        if self.reference is None:
            return out
        out.append(again(self.anchors_of(self.reference.index("annotations"), self.reference_images())))
        rules = [("outcome = 'modified'", "original_anchor_modified", "anchor")]
        if self.strict:
            rules.append(("outcome = 'missing'", "original_anchor_missing", "anchor"))
        else:
            rules.append(("outcome = 'preserved' AND image_moved", "anchor_image_id_remapped", "anchor", "info"))
            rules.append(("outcome = 'preserved' AND id_moved", "anchor_annotation_id_remapped", "anchor", "info"))
            if self.verbose:
                rules.append(("outcome = 'filtered'", "known_filtered_anchor", "anchor", "info"))
        out.append(flagged(self.anchor_outcomes(), rules))
        out.append(found(self.added_on_new_tracks(), "added_annotation_on_new_track", "anchor"))
        if self.verbose and self.full is not self.reference:
            lost = self.reference.index("annotations").join(self.reference.index("images").select(F.col("id").alias("image_id")), "image_id", "left_anti")
            out.append(found(lost, "reference_image_fallback_to_full", "anchor", "info"))
        return out

    def _box_rules(self, a: DataFrame) -> tuple[DataFrame, list[tuple]]:
        """Linked annotations with what the box rules need, and the rules."""
        if self.reference is not None:
            old = self.anchors_of(self.reference.index("annotations"), self.reference_images()).select(F.struct(*ANCHOR).alias("k")).distinct().withColumn("_old", F.lit(True))
            key = F.struct("video_id", F.col("i_frame_key").alias("frame_key"), "track_id", "category_id")
            a = a.withColumn("k", F.when(F.col("i_there") & F.col("i_frame_key").isNotNull(), key)).join(old, "k", "left")
            a = a.withColumn("inherited", F.coalesce("_old", F.lit(False)))
        else:
            a = a.withColumn("inherited", F.lit(False))
        hard = F.lit(True) if self.strict else ~F.col("inherited")
        b, sized = bbox(), F.col("i_width").isNotNull() & F.col("i_height").isNotNull()
        valid = F.col("bbox_ok")
        if not self.strict:
            inside = F.greatest(F.lit(0.0), F.least(b.x2, F.col("i_width")) - F.greatest(b.x1, F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(b.y2, F.col("i_height")) - F.greatest(b.y1, F.lit(0.0)))
            area = F.when(F.col("has_area"), F.col("area")).otherwise(b.area)
            dropped = F.col("ignore") | F.coalesce(area <= 0, F.lit(False)) | (b.w < 1) | (b.h < 1) | (F.when(sized, inside).otherwise(0.0) == 0)
            valid = valid & (~F.col("i_there") | ~dropped)
        a = a.withColumn("_valid", F.coalesce(valid, F.lit(False)))
        a = a.withColumn("_over", F.when(F.col("_valid") & F.col("i_there") & sized, overshoot(b, F.col("i_width"), F.col("i_height"))))
        beyond = F.coalesce(F.col("_over") > self.tolerance, F.lit(False))
        small = beyond & (F.col("_over") <= overshoot_limit(F.col("i_width"), F.col("i_height")))
        flat = F.col("_valid") & ((b.w <= 0) | (b.h <= 0))
        wrong = F.col("_valid") & F.col("has_area") & (F.col("area").isNull() | ~close(F.col("area"), b.area, self.area_tolerance, self.tolerance))
        bad, inherited = ~F.col("bbox_ok"), F.col("inherited")
        rules = [
            (bad & hard, "invalid_bbox_format", "bbox"),
            (flat & hard, "nonpositive_bbox", "bbox"),
            (beyond & ~small & ~inherited, "bbox_out_of_bounds", "bbox"),
            (wrong & hard, "area_mismatch", "bbox"),
        ]
        if self.strict:
            rules += [(small, "bbox_boundary_overshoot", "bbox", "warning"), (beyond & ~small & inherited, "inherited_bbox_boundary_overshoot", "bbox", "warning")]
        elif self.verbose:
            rules += [
                ((bad | flat) & inherited, "inherited_invalid_bbox", "bbox", "info"),
                (small, "bbox_boundary_overshoot_within_tolerance", "bbox", "info"),
                (beyond & ~small & inherited, "inherited_bbox_boundary_overshoot", "bbox", "info"),
                (wrong & inherited, "inherited_area_mismatch", "bbox", "info"),
            ]
        return a, rules

    def class_counts(self) -> dict[str, int]:
        split = self.spark.createDataFrame(self.split_pairs or [], "category_id string, novel boolean")
        split = split.groupBy("category_id").agg(F.max("novel").alias("novel"), F.max((~F.col("novel")).cast("int")).alias("base"))
        a = self.current.section("annotations").join(F.broadcast(split), "category_id", "left")
        row = a.agg(F.count_if(F.col("base") == 1).alias("base"), F.count_if("novel").alias("novel"), F.count_if(F.col("novel").isNull()).alias("none")).first()
        return {"base_annotations": row["base"], "novel_annotations": row["novel"], "unclassified_annotations": row["none"]}

    def effective_novel(self) -> int:
        """Annotations of novel categories that training could see, by frame sampling and class list."""
        t = self.training
        frames = training_frames(self.current.index("images", last=True), t.get("interval", 1), t.get("scope", 0), t.get("original_only", False), t.get("extra_ratio", 0.0))
        a = self._with(self.current.section("annotations").filter("bbox_ok"), "images", "image_id", ["width", "height"]).filter("i_there")
        a = a.join(frames.select(F.col("id").alias("image_id")).distinct(), "image_id", "left_semi")
        novel = self.spark.createDataFrame([(c,) for c, n in self.split_pairs or [] if n], "category_id string").distinct()
        from trackmill.operators.filters import effective

        a = a.filter(effective(bbox(), F.col("i_width"), F.col("i_height"), F.col("ignore"), F.coalesce("area", F.lit(0.0)))).join(F.broadcast(novel), "category_id", "left_semi")
        if t.get("allowed") is not None:
            a = a.join(F.broadcast(self.spark.createDataFrame([(c,) for c in t["allowed"]], "category_id string")), "category_id", "left_semi")
        return a.count()

    def leakage(self) -> list[DataFrame]:
        if self.split != "base-only":
            return []
        if self.split_pairs is None:
            return [self._counted({"category_split_missing": 1, **self.split_issues}, "leakage")]
        counts, out = self.class_counts(), [self._counted(self.split_issues, "leakage")]
        novel = counts["novel_annotations"]
        none = {"unclassified_annotation_category": counts["unclassified_annotations"]}
        out.append(self._counted(none, "leakage", "warning" if self.strict else "error"))
        if self.strict:
            out.append(self._counted({"novel_annotation_in_base_only": novel}, "leakage"))
        elif self.training.get("confirmed"):
            seen = self.effective_novel()
            out.append(self._counted({"effective_novel_annotation_in_training": seen}, "leakage"))
            if self.verbose and not seen:
                out.append(self._counted({"raw_novel_filtered_by_training_protocol": novel}, "leakage", "info"))
        else:
            out.append(self._counted({"training_protocol_unresolved": novel}, "leakage"))
            if self.verbose and not novel:
                out.append(self._counted({"training_protocol_not_required_raw_novel_zero": 1}, "leakage", "info"))
        return out

    def overlap(self) -> list[DataFrame]:
        if self.validation is None:
            return []
        mine, other = self.index["videos"], self.validation.index("videos")
        ids = mine.select(F.col("id").alias("v")).intersect(other.select("id"))
        names = mine.filter("name IS NOT NULL").select(F.col("name").alias("v")).intersect(other.filter("name IS NOT NULL").select("name"))
        both = ids.union(names).distinct().withColumn("ord", F.lit(None).cast("long"))
        return [found(both, "train_validation_video_overlap", "split_overlap")]

    def _counted(self, counts: dict[str, int], group: str, severity: str = "error") -> DataFrame:
        rows = [(severity, k, group, None, n, None) for k, n in counts.items() if n]
        return self.spark.createDataFrame(rows, FINDING)

    def findings(self) -> DataFrame:
        rules = [*self.schema(), *self.references(), *self.annotations(), *self.identity(), *self.anchors(), *self.leakage(), *self.overlap()]
        return reduce(DataFrame.unionByName, rules)

    # --- report ---------------------------------------------------------------------------------

    def observations(self) -> DataFrame:
        """Valid, positive boxes on known images with a whole frame."""
        a = self.linked().filter("bbox_ok AND i_there AND i_frame_index IS NOT NULL").filter("bbox[2] > 0 AND bbox[3] > 0")
        return a.select("video_id", "track_id", "image_id", "ord", F.col("i_frame_index").alias("frame"), "bbox", "visibility")

    def anchor_summary(self) -> dict | None:
        o = self.anchor_outcomes()
        if o is None:
            return None
        rows = o.groupBy("outcome", "changed").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row per set of fields
        counts: dict[str, int] = {}
        fields: dict[str, int] = {}
        for r in rows:
            counts[r.outcome] = counts.get(r.outcome, 0) + r["n"]
            for f in r.changed or []:
                fields[f] = fields.get(f, 0) + r["n"]
        added_new = self.added_on_new_tracks().count()
        out = {k: counts.get(k, 0) for k in ("preserved", "missing", "filtered", "modified")}
        return out | {"added_annotations": counts.get("added", 0), "modified_fields": dict(sorted(fields.items())), "added_annotations_on_new_tracks": added_new}

    def report(self, examples: int = 20, temporal: bool = False, thresholds: dict | None = None) -> dict:
        """Status, counts and bounded examples; everything collected here is bounded by the rules."""
        f = self.findings().persist()
        counts = f.groupBy("severity", "group", "kind").agg(F.sum("n").alias("n")).collect()
        w = Window.partitionBy("severity", "kind").orderBy("ord", "details")
        named = f.filter("ord IS NOT NULL OR details IS NOT NULL")
        some = named.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= examples).select("severity", "kind", "ord", "details").collect()
        f.unpersist()
        total = lambda s: sum(r["n"] for r in counts if r.severity == s)
        by = lambda s: {r.kind: r["n"] for r in sorted(counts) if r.severity == s}
        shown: dict[str, dict[str, list[dict]]] = {}
        for r in sorted(some, key=lambda r: (r.severity, r.kind, r.ord is not None, r.ord or 0, r.details or "")):
            where = {} if r.ord is None else {"ord": r.ord}
            shown.setdefault(r.severity, {}).setdefault(r.kind, []).append(where | json.loads(r.details or "{}"))
        seen = {r.kind for r in counts}
        status = "FAIL" if total("error") else "PASS WITH WARNINGS" if self.strict and total("warning") else "PASS"
        groups = {g: sum(r["n"] for r in counts if r.severity == "error" and r.group == g) for g in GROUPS}
        rows = self.current.rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("t"), F.max(F.col("track_id").isNull().cast("int")).alias("null_t")).collect()
        sizes = {s: next((r["n"] for r in rows if r.section == s), 0) for s in self.index}
        tracked = next((r["t"] + r["null_t"] for r in rows if r.section == "annotations"), 0)
        screens: dict[str, int] = {}
        if temporal or self.strict:
            screens = {f"temporal_{r.flag_type}": r["n"] for r in temporal_screens(self.observations(), thresholds).groupBy("flag_type").agg(F.count(F.lit(1)).alias("n")).collect()}
        leak = self.class_counts() if self.split == "base-only" and self.split_pairs is not None else None
        return {
            "status": status,
            "examples_are_capped_at": examples,
            "aliases": {old: kind for kind, old in ALIASES.items() if kind in seen},
            "counts": sizes | {"distinct_annotated_tracks": tracked},
            "hard_errors": {"total": total("error"), "by_type": by("error"), "by_group": groups, "examples": shown.get("error", {})},
            "warnings": {"total": total("warning"), "by_type": by("warning"), "examples": shown.get("warning", {})},
            "infos": {"total": total("info"), "by_type": by("info"), "examples": shown.get("info", {})},
            "diagnostics": {"total": sum(screens.values()), "by_type": screens},
            "anchors": self.anchor_summary(),
            "leakage": leak,
        }


def repeats_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key by ord."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def training_frames(images: DataFrame, interval: int = 1, scope: int = 0, original_only: bool = False, extra_ratio: float = 0.0, seed: int = 42) -> DataFrame:
    """(id, role) of the images that training may read: key frames, and references within ``scope``.

    Key frames are each interval-th of a video or, with original_only, its original frames and a share
    of the other strided ones, those with the smallest hashes.
    """
    w = Window.partitionBy("video_id").orderBy(F.coalesce("frame_id", F.lit(0)), "id")
    placed = images.select("id", "video_id", "frame_id", "is_ori").withColumn("_p", F.row_number().over(w) - 1)
    strided = F.col("_p") % max(1, interval) == 0
    if original_only:
        chosen = Window.partitionBy("video_id")
        room = F.floor(F.count_if("is_ori").over(chosen) * extra_ratio)
        candidate = strided & ~F.col("is_ori")
        rank = F.row_number().over(Window.partitionBy("video_id", candidate).orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id"))
        key = placed.withColumns({"_room": room, "_rank": rank}).filter(F.col("is_ori") | (candidate & (F.col("_rank") <= F.col("_room"))))
    else:
        key = placed.filter(strided)
    near = key.select("video_id", F.col("_p").alias("_k"), F.explode(F.sequence(F.col("_p") - scope, F.col("_p") + scope)).alias("_p")).filter("_p <> _k")
    refs = placed.join(near.select("video_id", "_p").distinct(), ["video_id", "_p"], "left_semi")
    return key.select("id", F.lit("key").alias("role")).unionByName(refs.select("id", F.lit("reference").alias("role")))


def temporal_screens(observations: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """(video_id, track_id, frame_t, frame_t1, flag_type, measured_value, threshold) of all screens.

    One window pass over each track by (frame, image); the visibility screen needs both values.
    """
    t = THRESHOLDS | (thresholds or {})
    w = Window.partitionBy("track_id").orderBy("frame", "image_id", "ord")
    o = observations.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("video_id", "frame", "bbox", "visibility")})
    same = F.col("bbox").eqNullSafe(F.col("p_bbox"))
    o = o.withColumn("_run", F.sum((~same).cast("int")).over(w))
    o = o.withColumn("_length", F.row_number().over(Window.partitionBy("track_id", "_run").orderBy("frame", "image_id", "ord")))
    a, b = bbox("p_"), bbox()
    gap = F.col("frame") - F.col("p_frame")
    measures = {
        "temporal_gap": (gap, gap > t["temporal_gap"]),
        "track_reappearance": (gap, gap > t["track_reappearance"]),
        "low_iou": (v := iou_or_zero(a, b), v < t["low_iou"]),
        "center_displacement": (v := displacement(a, b), v > t["center_displacement"]),
        "box_size_jump": (v := ratio_of_larger(a.area, b.area), v > t["box_size_jump"]),
        "aspect_ratio_jump": (v := ratio_of_larger(a.w / a.h, b.w / b.h), v > t["aspect_ratio_jump"]),
        "visibility_jump": (v := F.abs(F.col("visibility") - F.col("p_visibility")), v > t["visibility_jump"]),
    }
    flag = lambda name, value, fires: F.when(fires, F.struct(F.lit(name).alias("flag_type"), value.cast("double").alias("measured_value"), F.lit(float(t[name])).alias("threshold")))
    steps = F.array(*[flag(n, v, F.col("p_frame").isNotNull() & f) for n, (v, f) in measures.items()], flag("identical_bbox_run", F.col("_length"), F.col("_length") == t["identical_bbox_run"]))
    steps = o.select("video_id", "track_id", F.col("p_frame").alias("frame_t"), F.col("frame").alias("frame_t1"), F.explode(F.array_compact(steps)).alias("f")).select("video_id", "track_id", "frame_t", "frame_t1", "f.*")
    lengths = observations.groupBy("track_id").agg(F.min_by("video_id", F.struct("frame", "image_id", "ord")).alias("video_id"), F.min("frame").alias("frame_t"), F.max("frame").alias("frame_t1"), F.count(F.lit(1)).alias("n"))
    short = lengths.filter(F.col("n") < t["track_length_anomaly"]).select("video_id", "track_id", "frame_t", "frame_t1", F.lit("track_length_anomaly").alias("flag_type"), F.col("n").cast("double").alias("measured_value"), F.lit(float(t["track_length_anomaly"])).alias("threshold"))
    return steps.unionByName(short)


def write_report(report: dict, path: str) -> None:
    """Sorted, indented JSON with a last newline; numbers that JSON has not become texts."""
    safe = lambda x: {k: safe(v) for k, v in x.items()} if isinstance(x, dict) else [safe(v) for v in x] if isinstance(x, (list, tuple)) else str(x) if isinstance(x, float) and not math.isfinite(x) else x
    with open(path, "w", encoding="utf-8") as f:
        json.dump(safe(report), f, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")


def run(spark: SparkSession, current: str, original: str | None = None, **options) -> Checks:
    """Checks of the documents at the paths given."""
    reference = Dataset.read(spark, original) if original else None
    return Checks(Dataset.read(spark, current), reference, **options)

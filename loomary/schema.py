"""Fixed names and schemas of the media corpus."""

from __future__ import annotations

from pyspark.sql import types as T

#: The caption fields; their order decides the order of joined text and ties for the best field.
FIELD_NAMES = ["image_composition", "character_name", "expression", "action", "subjective_emotion", "text_in_image", "usage_context", "wechat_keyword", "manual_tags", "notes"]

#: Texts that stand for "nothing", exact in case; a display client knows fewer of them.
PLACEHOLDERS = ["", "none", "NONE", "无", "未知", "null", "NULL", "N/A", "n/a"]
CLIENT_PLACEHOLDERS = ["", "NONE", "none", "无", "未知", "null", "N/A"]

#: Image suffixes, the mark between joined values, zero-shot labels.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp"]
JOINT = "；"
ZERO_SHOT_LABELS = ["real_person", "real_people_group", "cartoon_character", "drawn_comic", "text_meme", "screenshot", "animal", "object_food"]

#: Columns of the cluster table and of the review catalog.
CLUSTER_COLUMNS = ["path", "file_name", "asset_type", "asset_confidence", "visual_cluster_id", "near_duplicate_group", "cluster_size", "duplicate_group_size", "width", "height", "aspect_ratio", "suffix", "dhash", "ahash", "color_diversity", "edge_density", "saturation_mean", "brightness_mean", "encoder"]
CATALOG_FACTS = ["path", "file_name", "source_path", "asset_type", "asset_confidence", "visual_cluster_id", "near_duplicate_group", "cluster_size", "duplicate_group_size"]
CATALOG_COLUMNS = CATALOG_FACTS + FIELD_NAMES


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CAPTION = T.StructType(_strings(FIELD_NAMES))
CAPTION_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        *_strings(["model", "endpoint", "source", "semantic_text", "error"]),
        T.StructField("caption", CAPTION),
        T.StructField("usage", T.MapType(T.StringType(), T.StringType())),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("cluster", T.StructType(_strings(["visual_cluster_id", "cluster_size", "asset_type"]))),
    ]
)
MANIFEST_RECORD = T.StructType(
    [
        *_strings(["path", "source_path", "source_root", "relative_source_path", "original_name", "collection", "sha256"]),
        T.StructField("file_size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        *_strings(["suffix", "mode", "action", "imported_at", "pack_dir", "pack_name", "sticker_id", "name", "md5"]),
    ]
)
PACK = T.StructType(
    [
        T.StructField("packName", T.StringType()),
        T.StructField("stickerCount", T.LongType()),
        T.StructField("stickers", T.ArrayType(T.StructType([*_strings(["stickerId", "name", "path", "md5"]), T.StructField("downloaded", T.BooleanType()), T.StructField("fileSize", T.LongType())]))),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

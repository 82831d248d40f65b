"""Paired-sample curation on PySpark: DataFrame operators, sources, sinks and plans.

The public names load their modules when first used.
"""

from importlib import import_module

_HOMES = {
    "Settings": "plans.curation",
    "curate": "plans.curation",
    "differences": "plans.curation",
    "ordered_pairs": "operators.pairs",
    "pair_by_stem": "operators.pairs",
    "pair_masks": "operators.pairs",
    "with_prompts": "operators.pairs",
    "worker_shares": "operators.order",
    "positional_join": "operators.order",
    "bucket_batches": "operators.batches",
    "rank_batches": "operators.batches",
    "augment": "operators.augment",
    "top_detections": "operators.boxes",
    "main_regions": "operators.boxes",
    "validated": "operators.boxes",
    "reason_counts": "operators.boxes",
    "best_boxes": "operators.boxes",
    "instantiate": "operators.slots",
    "iou": "functions.boxes",
    "difference_heat": "functions.raster",
    "expanded": "functions.raster",
    "resized": "functions.resample",
    "resize_pictures": "functions.resample",
    "paste_back": "functions.resample",
    "text_table": "operators.text_table",
    "write_pictures": "sources.picture_sink",
    "zip_manifests": "sources.tables",
    "key_columns": "sources.tables",
    "read_shards": "sources.shards",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)

"""Export of reviewed candidates into the stored ground truth, in two phases.

Publishing merges boxes and then images into their tables; marking sets the flag of the candidates. Nothing else
joins the two, so an export may stop anywhere and be run again: entries are keyed by image (and box), so what was
published already is put once more with the same content, and candidates are marked only once their image is
in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.operators import review
from boxtally.session import cut_lineage
from boxtally.sources.change_log import LoggedTable

IMAGES = """image string, source string, annotation_run_id string, expected_barcode_symbol_count int,
    expected_decoded_count int"""
BOXES = "image string, box_no int, status string, value string, format string"


class GroundTruthStore:
    def __init__(self, images: LoggedTable, boxes: LoggedTable):
        self.images, self.boxes = images, boxes

    def publish(self, entries: DataFrame) -> None:
        """Merge the entries of :func:`review.export_entries`; an image counts once its row is there."""
        self.boxes.put(entries.where("box_status is not null").select(
            "image", F.col("box_no").cast("int").alias("box_no"), F.col("box_status").alias("status"), "value", "format"))
        self.images.put(review.image_entries(entries))

    def export(self, queue: LoggedTable, expected: DataFrame, inventory: DataFrame) -> DataFrame:
        """Publish what is reviewed and not exported, mark it, and return the summary of the whole store."""
        self.publish(cut_lineage(review.export_entries(queue.read(), expected, inventory)))
        self.mark(queue, inventory)
        return review.images_summary(self.images.read())

    def mark(self, queue: LoggedTable, inventory: DataFrame) -> None:
        """Mark the candidates whose image the store holds."""
        ready = review.export_ready(queue.read(), inventory)
        held = cut_lineage(ready.join(self.images.read().select("image"), "image", "left_semi").select("id"))
        queue.update(held, lambda rows: review.mark_exported(rows, held))

"""Page dialects: which tags a dialect knows, which of them an edit may add, and the suffix of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Dialect -> suffix, tags, and the leaves among them.
DIALECTS = {
    "components": (
        ".mdx",
        "Accordion AccordionGroup Card CardGroup CodeGroup Frame Info Note Step Steps Tab Tabs Tip Warning",
        "Accordion Card Info Note Step Tab Tip Warning",
    ),
    "admonitions": (".md", "Details TabItem Tabs caution danger info note tip warning", ""),
    "markdown": (".md", "", ""),
}


def table(spark: SparkSession) -> DataFrame:
    """dialect, suffix, tag, leaf: a row for each tag of each dialect, one with a null tag for a dialect without any."""
    rows = [(d, suffix, tag, tag in leaves.split()) for d, (suffix, tags, leaves) in DIALECTS.items() for tag in tags.split() or [None]]
    return spark.createDataFrame(rows, "dialect string, suffix string, tag string, leaf boolean")

"""Connected components of a table of links, without collecting any of it.

Labels spread to the smallest id: each round takes the least label among neighbours, then follows labels of labels
(pointer jumping), so long chains shrink fast. Each round is a written table, which cuts the lineage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.shared import remove, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in links; component is the smallest id reachable. Repeated links, loops and
    both directions are allowed; NULL ends are ignored. An empty table gives an empty one."""
    spark = links.sparkSession
    both = links.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e"))
    edges = written(both.select("e.u", "e.v").filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("m"))
        low = labels.join(seen, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        low = written(low, "labels")
        jump = low.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = written(low.join(jump, "c").select("id", "old", F.col("cc").alias("c")), "labels")
        moved = new.filter("c < old").limit(1).count()
        remove(spark, labels, low)
        labels = new
        if not moved:
            remove(spark, edges)
            return labels.select("id", F.col("c").alias("component"))

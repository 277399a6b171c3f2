"""Near copies: SimHash links and the exact similarity of shingle sets; one document of each group stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import ngrams, simhash
from assayer.llm.graph import components
from assayer.llm.store import bounded_batches, keep, release

#: Words of a shingle, least similarity of a link in hundredths, differing fingerprint bits of a link.
WIDTH, PERCENT, RADIUS = 5, 80, 4


def _same_prints(docs: DataFrame, prints: DataFrame, text: str, radius: int) -> DataFrame:
    """Edges between nodes whose SimHash fingerprints differ in `radius` bits or fewer, found by bit-sliced comparison.

    A fingerprint is computed once for each text; equal ones link to the least node among them, linked ones by those.
    """
    first = docs.select(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key"), F.col(f"`{text}`").alias("text"))
    bits = keep(simhash.fingerprints(first, "key", "text", WIDTH).distinct(), "fingerprints")
    named = keep(prints.select(F.col("text_key").alias("id"), "node").distinct().join(bits, "id").select("node", "bits").distinct(), "named")
    least = named.groupBy("bits").agg(F.min("node").alias("least"))
    star = named.join(least, "bits").select(F.col("least").alias("a"), F.col("node").alias("b"))
    far = simhash.links(named.select("bits").distinct(), radius)
    for end in ("a", "b"):
        far = far.join(least.select(F.col("bits").alias(end), F.col("least").alias(f"{end}_node")), end)
    out = keep(star.unionByName(far.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))).where("a <> b").distinct(), "links")
    release(bits, named)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, tile: int | None = None, radius: int | None = None) -> DataFrame:
    """(id, text_key, node, root): every row's shingle set and the smallest one that its links reach.

    Texts of equal five-word shingle sets are one node. Two nodes link if the Jaccard similarity of their sets is at least
    `percent` hundredths, exactly (see ngrams.py), and, if a `radius` is given, if their SimHash fingerprints differ in so
    many bits or fewer. Groups are chains of links. Texts without a word are one node.
    """
    bounded_batches(docs.sparkSession)
    prints = keep(ngrams._prints(docs, id_col, text, WIDTH, percent), "prints")
    links = [ngrams.links(docs, prints, text, WIDTH, percent, tile)]
    if radius is not None:
        links.append(_same_prints(docs, prints, text, radius))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    found = components(edges)
    out = keep(prints.select("id", "text_key", "node").join(found, "node", "left").select("id", "text_key", "node", F.coalesce("root", "node").alias("root")), "groups")
    release(prints, found, *links)
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, one row of each near-duplicate group: that of the smallest id.

    Groups are chains of SimHash links within RADIUS bits and of exact Jaccard links from PERCENT hundredths on, both over
    words in lower case (A-Z). Texts without a word are one group; null text counts as empty. A row with null id stays only
    if its group has no row with an id; of several such, or of repeated ids, one stays. An empty table gives an empty one.
    """
    placed = groups(docs, id_col, text, radius=RADIUS)
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("m"))
    stay = keep(best.select(F.coalesce("m.id", "m.text_key").alias("_key"), F.col("m.text_key").alias("_text")), "stay")
    release(placed)
    own = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("_own")).withColumn("_id", F.coalesce(F.col(f"row.`{id_col}`").cast("long"), "_own"))
    joined = rows.join(stay, (rows["_id"] == stay["_key"]) & (rows["_own"] == stay["_text"]))
    one = Window.partitionBy("_id", "_own").orderBy(F.xxhash64("row"))
    return joined.withColumn("_r", F.row_number().over(one)).where("_r = 1").select("row.*")

"""Lookups over three catalogues: branded, generics and master, chained as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import or_default, strip
from quillmatch.sources import scratch
from quillmatch.operators.match import MatchIndex, fit_stacked, fit_stored, top_k

#: Output name -> column of the catalogue, and the default where the column is absent from it.
BRANDED = {
    "name": ("name", ""), "price": ("price(₹)", ""), "manufacturer": ("manufacturer_name", ""), "type": ("type", ""), "pack_size": ("pack_size_label", ""),
    "composition1": ("short_composition1", ""), "composition2": ("short_composition2", ""), "is_discontinued": ("Is_discontinued", "FALSE"),
}
GENERIC = {"generic_name": ("Generic Name", ""), "mrp": ("MRP", ""), "unit_size": ("Unit Size", ""), "category": ("Group Name", "")}
MASTER = {
    "brand_name": ("brand_clean", ""), "canonical_name": ("canonical_inn", ""), "composition": ("composition_raw", ""), "manufacturer": ("manufacturer", ""), "is_generic": ("is_generic", ""),
    "product_price": ("product_price", ""), "nppa_price": ("nppa_price", ""), "price_flag": ("price_flag", ""), "ratio_market_to_nppa": ("ratio_market_to_nppa", ""),
}
#: Where a header is missing another column stands in. That is a choice of the plan, not of each row.
STAND_INS = {"price(₹)": "price", "brand_clean": "brand_raw"}


def column_or(df: DataFrame, name: str, default: str) -> Column:
    """The column if the table has it, else the one that stands in for it, else the default."""
    for n in (name, STAND_INS.get(name)):
        if n in df.columns:
            return F.col(f"`{n}`")
    return F.lit(default)


def project(catalogue: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``doc_id`` and the output columns of a catalogue."""
    return catalogue.select("doc_id", *[column_or(catalogue, c, d).alias(out) for out, (c, d) in fields.items()])


@dataclass
class Catalogue:
    """The output columns of a catalogue, and the index that has it under the name ``cat``."""

    rows: DataFrame
    index: MatchIndex
    cat: str = ""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, rank``, the output columns and ``match_score`` of the best ``k`` rows for each query."""
        asked = queries.select(F.lit(self.cat).alias("cat"), "qid", "query")
        return self.named(top_k(self.index, asked, k))

    def named(self, found: DataFrame) -> DataFrame:
        """The matches of this catalogue in ``found(cat, qid, doc_id, rank, match_score)`` with its output columns."""
        return found.filter(F.col("cat") == self.cat).drop("cat").join(self.rows, "doc_id").drop("doc_id")


def branded_text(catalogue: DataFrame) -> Column:
    return column_or(catalogue, "name", "")


def generic_text(catalogue: DataFrame) -> Column:
    return column_or(catalogue, "Generic Name", "")


def master_text(catalogue: DataFrame) -> Column:
    """``brand_clean``, or ``canonical_inn`` where that header is missing."""
    name = "brand_clean" if "brand_clean" in catalogue.columns else "canonical_inn"
    return F.col(name) if name in catalogue.columns else F.lit("")


#: Catalogue -> its output columns and the text that is matched.
KINDS = {"branded": (BRANDED, branded_text), "generics": (GENERIC, generic_text), "master": (MASTER, master_text)}


def catalogues(keep: int = 5, stored: bool = False, **tables: DataFrame) -> list[Catalogue]:
    """The given catalogues, by the names of ``KINDS``, in one stacked index; a stored one pays where it is searched more than once."""
    texts = {name: (df.withColumn("text", KINDS[name][1](df)), "doc_id", "text") for name, df in tables.items()}
    index = fit_stored(texts, keep=keep) if stored else fit_stacked(texts, keep)
    return [Catalogue(project(df, KINDS[name][0]), index, name) for name, df in tables.items()]


def branded(catalogue: DataFrame) -> Catalogue:
    return catalogues(branded=catalogue)[0]


def generics(catalogue: DataFrame) -> Catalogue:
    return catalogues(generics=catalogue)[0]


def master(catalogue: DataFrame) -> Catalogue:
    return catalogues(master=catalogue)[0]


def search_both(queries: DataFrame, one: Catalogue, other: Catalogue, k: int) -> tuple[DataFrame, DataFrame]:
    """The matches of the same queries in two catalogues: by one search where one index has both."""
    if one.index is not other.index:
        return one.search(queries, k), other.search(queries, k)
    cats = F.explode(F.array(F.lit(one.cat), F.lit(other.cat))).alias("cat")
    found = scratch.stored(top_k(one.index, queries.select(cats, "qid", "query"), k), "found")  # at most k rows a query; read several times
    return one.named(found), other.named(found)


def composition_query(first: Column, second: Column, query: Column) -> Column:
    """What to ask the generics for: the best match's composition, else the query."""
    both = strip(F.concat(first, F.lit(" "), F.coalesce(second, F.lit(""))))
    return F.when(F.coalesce(first, F.lit("")) != "", both).otherwise(query)


def price_info(best: DataFrame) -> DataFrame:
    """``qid`` and a struct of prices from the first master match."""
    fields = F.struct("product_price", F.col("nppa_price").alias("nppa_ceiling_price"), "price_flag", F.col("ratio_market_to_nppa").alias("ratio"))
    return best.filter("rank = 1").select("qid", fields.alias("price_info"))


def in_order(matches: DataFrame, name: str) -> DataFrame:
    """``qid`` and the matches as an array by rank (at most k structs)."""
    fields = [c for c in matches.columns if c not in ("qid", "rank")]
    rows = matches.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("match")))).alias("m"))
    return rows.select("qid", F.transform("m", lambda x: x["match"]).alias(name))


def lookup(queries: DataFrame, names: Catalogue, subs: Catalogue, prices: Catalogue) -> DataFrame:
    """One row a query: ``qid, query, branded_matches, generic_alternatives, master_matches, price_info``.

    Generics are searched by the composition of the first branded match, so the second search is a
    query table derived from the first; catalogues of one stacked index are searched together. ``price_info`` is of the first master match, whatever brand
    came first.
    """
    brand, prime = search_both(queries, names, prices, 3)
    first = brand.filter("rank = 1").select("qid", "composition1", "composition2")
    asked = queries.join(first, "qid", "left").select("qid", composition_query(F.col("composition1"), F.col("composition2"), F.col("query")).alias("query"))
    out = queries.select("qid", "query")
    for part in (in_order(brand, "branded_matches"), in_order(subs.search(asked, 5), "generic_alternatives"), in_order(prime, "master_matches"), price_info(prime)):
        out = out.join(part, "qid", "left")
    for name in ("branded_matches", "generic_alternatives", "master_matches"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def alternatives(generic_matches: Column) -> Column:
    """Cheaper alternatives in order of similarity; price is text and orders nothing; there is no drug code."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    price = lambda g: F.concat(F.lit("₹"), blank(g["mrp"]), F.lit(" for "), blank(g["unit_size"]))
    return F.transform(
        generic_matches,
        lambda g: F.struct(blank(g["generic_name"]).alias("name"), price(g).alias("price"), F.lit("jan_aushadhi").alias("source"), F.lit("").alias("drug_code")),
    )


def enriched(price: Column, info: Column) -> list[Column]:
    """Price, ceiling and flag after the lookup: a price that is there stays, the others come from the lookup."""
    some = info.isNotNull()
    return [
        F.when(some, or_default(price, F.coalesce(info["product_price"], F.lit("")))).otherwise(price).alias("price"),
        F.when(some, F.coalesce(info["nppa_ceiling_price"], F.lit(""))).otherwise(F.lit("")).alias("nppa_ceiling_price"),
        F.when(some, F.coalesce(info["price_flag"], F.lit(""))).otherwise(F.lit("")).alias("price_flag"),
    ]

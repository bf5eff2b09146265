"""Format rules as violations: one row (rule, scope, idx, observed) for each.

Row rules are one pass of expressions; block rules read the small block table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posframe import schema as S

#: scope of each row rule, and when it is broken; columns as stored.
def row_rules(max_feature_id: int = S.MAX_FEATURE_ID, scale: float = S.FIXED_SCALE, clip: float = S.STORAGE_TARGET_CLIP) -> list[tuple[str, str, Column, Column]]:
    stored = F.shiftright("flags", 1).bitwiseAND(F.lit(31))
    return [
        ("flags_reserved_bits", "flags", F.col("flags").bitwiseAND(F.lit(0xC0)) != 0, F.col("flags")),
        ("flags_count_sentinel", "flags", stored == 31, F.col("flags")),
        ("eval_bound", "eval", F.abs(F.col("eval_raw").cast("int")) > int(clip * scale), F.col("eval_raw")),
        ("wdl_domain", "wdl", ~F.col("wdl").isin(-1, 0, 1), F.col("wdl")),
        ("feature_bound", "features", F.exists("features", lambda x: (x < 0) | (x >= max_feature_id)), F.array_max("features")),
        ("count_is_nnz", "features", stored + S.COUNT_BASE != F.size("features"), F.size("features")),
    ]


def input_rules(max_feature_id: int = S.MAX_FEATURE_ID) -> list[tuple[str, str, Column, Column]]:
    return [
        ("stm_domain", "input", ~F.col("stm").isin(0, 1), F.col("stm")),
        ("count_domain", "input", ~F.col("piece_count").between(S.COUNT_BASE, S.MAX_COUNT), F.col("piece_count")),
        ("size_is_count", "input", F.size("features") != F.col("piece_count"), F.size("features")),
        ("feature_bound", "input", F.exists("features", lambda x: (x < 0) | (x >= max_feature_id)), F.array_max("features")),
        ("wdl_domain", "input", ~F.col("wdl").isin(-1, 0, 1), F.col("wdl")),
    ]


def violations(df: DataFrame, rules: list[tuple[str, str, Column, Column]], idx: str = "idx") -> DataFrame:
    """rule, scope, idx, observed of every broken rule, a row's in the order of the rules; a null counts as broken."""
    each = [F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("scope"), F.col(idx).cast("long").alias("idx"), seen.cast("long").alias("observed"))) for r, s, broken, seen in rules]
    return df.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("v")).select("v.*")


#: The block rules in the order in which they are checked.
BLOCK_RULES = ("prefix_length", "first_anchor", "anchor_recurrence", "prefix_first", "prefix_monotone", "prefix_end", "last_block_padding", "feature_total")


def block_violations(blocks: DataFrame, features_total: int, size: int = S.BLOCK_SIZE, max_count: int = S.MAX_COUNT, last_rows: int | None = None) -> DataFrame:
    """Broken rules of the block index (block_id, anchor, prefix). Blocks are reduced to
    their numbers first, and each meets the next one by a join, so arrays stay where they are read."""
    total = F.element_at("prefix", -1)
    entry = lambda i: F.try_element_at("prefix", F.lit(i))
    padded = F.exists(F.slice("prefix", last_rows + 1, size + 1 - last_rows), lambda x: x != entry(last_rows + 1)) if last_rows is not None else F.lit(False)
    own = blocks.select(
        "block_id", "anchor", F.size("prefix").alias("n"), entry(1).alias("first"), total.alias("total"), padded.alias("padded"),
        F.exists(F.sequence(F.lit(2), F.greatest(F.size("prefix"), F.lit(2))), lambda i: F.try_element_at("prefix", i) < F.try_element_at("prefix", i - 1)).alias("falls"),
    )
    following = own.select((F.col("block_id") - 1).alias("block_id"), F.col("anchor").alias("next"), F.lit(False).alias("last"))
    own = own.join(following, "block_id", "left").withColumn("last", F.coalesce("last", F.lit(True))).withColumn("end", F.col("anchor") + F.col("total"))
    last, end, total = F.col("last"), F.col("end"), F.col("total")
    broken = {
        "prefix_length": (F.col("n") != size + 1, F.col("n")), "first_anchor": ((F.col("block_id") == 0) & (F.col("anchor") != 0), F.col("anchor")),
        "anchor_recurrence": (~last & (F.col("next") != end), F.col("next")), "prefix_first": (F.col("first") != 0, F.col("first")), "prefix_monotone": (F.col("falls"), total),
        "prefix_end": (total > size * max_count, total), "last_block_padding": (last & F.col("padded"), total), "feature_total": (last & (end != features_total), end),
    }
    return violations(own, [(r, "blocks", *broken[r]) for r in BLOCK_RULES if r != "last_block_padding" or last_rows is not None], "block_id")


def checked(found: DataFrame) -> None:
    """ValidationError with the first violation, if there is one: of the least row, by the order of the rules."""
    order = F.array_position(F.array(*[F.lit(r) for r in (*BLOCK_RULES, *(r[0] for r in row_rules()))]), F.col("rule"))
    first = found.orderBy("idx", order).limit(1).collect()
    if first:
        raise S.ValidationError(str(first[0].asDict()))


def metadata_problem(text: Column, fmt: str = S.FORMAT_NAME, layout: str = S.LAYOUT_NAME) -> Column:
    """Why a JSON trailer is not valid, null if it is."""
    parsed = F.try_parse_json(text) if hasattr(F, "try_parse_json") else F.from_json(text, "map<string,string>")
    field = lambda k: F.get_json_object(text, f"$.{k}")
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty").when(parsed.isNull(), "not JSON").when(~F.trim(text).startswith("{"), "not an object")
        .when(~field("format").eqNullSafe(F.lit(fmt)), "format").when(~field("layout").eqNullSafe(F.lit(layout)), "layout")
    )

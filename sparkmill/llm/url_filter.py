"""URL verdicts: longest host and path rule, else a blocked Bloom filter before an exact hash join. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import ascii_lower, materialize

#: Odd multipliers, one for each 64-bit word of a block (fixed values of the split-block design).
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Keys for a block of 8 x 64 bits: 16 bits a key, under 0.1 % false positives.
KEYS_PER_BLOCK = 32
#: A filter up to this many bytes is broadcast (its size is known from the count of keys); a larger one is joined by block.
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Canonical form: host without a leading `www.`, path without trailing slashes, no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. rules: (allow or block, host, path); equal lengths go by text."""
    best_rule, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best_rule, best_verdict = F.when(fits, F.lit(h + p)).otherwise(best_rule), F.when(fits, F.lit(verdict)).otherwise(best_verdict)
    return best_rule, best_verdict


def _bits(key: Column) -> list[Column]:
    """One bit of each of the eight words."""
    low = F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright((low % (1 << 31) * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int")) for m in MULTIPLIERS]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table: a row for each block that has a key, with its eight words. Partial sums shrink it before the shuffle."""
    return listed.groupBy(_block(F.col(key), n_blocks).alias("block")).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, canonical and `listed` for every row of pages.

    listed: a DataFrame whose first column has canonical URLs (nulls and repeats are ignored); a page that no rule fits is
    blocked if its canonical URL is listed, else allowed. The Bloom filter passes possible hits to an exact join, which
    removes the false positives; pages that miss never reach that join. A null url has an empty host and path, canonical ''
    is never listed. Repeated rows stay; other columns of pages are not read.
    """
    keys = materialize(listed.select(F.col(listed.columns[0]).alias("key")).where("key is not null and key <> ''").distinct(), "listed")
    n_keys, key_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 40), F.lit(0))).first()
    n_blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    blocks = bloom_blocks(keys, "key", n_blocks)
    if n_blocks * 72 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"), rule.alias("rule"), verdict.alias("ruled"))
    probed = rows.join(blocks, _block(F.col("canonical"), n_blocks) == F.col("block"), "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probed = probed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))
    if key_bytes <= BROADCAST_BYTES:  # one scan: what misses has no key to look up
        found = F.broadcast(keys.select("key", F.lit(True).alias("found")))
        seen = probed.join(found, F.when(F.col("maybe"), F.col("canonical")) == F.col("key"), "left").select(*rows.columns, F.coalesce("found", F.lit(False)).alias("listed"))
    else:
        maybe = probed.where("maybe").join(keys.select("key", F.lit(True).alias("found")), F.col("canonical") == F.col("key"), "left")
        seen = maybe.select(*rows.columns, F.coalesce("found", F.lit(False)).alias("listed")).unionByName(probed.where("not maybe").select(*rows.columns, F.lit(False).alias("listed")))
    return seen.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")

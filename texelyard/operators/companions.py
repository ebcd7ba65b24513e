"""Joins that bring together the files of one asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.functions import paths, rules
from texelyard.functions.binary import strip_header
from texelyard.operators.bloom import might_contain


def _existing(meta: DataFrame, listing: DataFrame, segment: str) -> DataFrame:
    """``meta`` with column ``segment``: the companion path if it is listed, else null.

    Only listed paths containing the segment can match, so the rest is dropped
    before the shuffle. A path without ``meta`` has no candidate; it joins on
    its own text behind a NUL, which no path holds, so such rows stay spread.
    """
    candidate = paths.replace_meta(F.col("path"), segment)
    key = F.when(candidate == "", F.concat(F.lit("\0"), F.col("path"))).otherwise(candidate)
    found = listing.filter(F.contains(F.col("path"), F.lit(segment))).select(F.col("path").alias(segment)).distinct()
    return meta.withColumn("_key", key).join(found, F.col("_key") == F.col(segment), "left").drop("_key")


def resolve_companions(meta: DataFrame, listing: DataFrame) -> DataFrame:
    """Payload files of each metadata path.

    ``companion`` is both, payload, paylow (the low file then serves as payload)
    or none.
    """
    probed = _existing(_existing(meta, listing, "payload"), listing, "paylow")
    has_payload, has_paylow = F.col("payload").isNotNull(), F.col("paylow").isNotNull()
    companion = (
        F.when(has_payload & has_paylow, "both")
        .when(has_payload, "payload")
        .when(has_paylow, "paylow")
        .otherwise("none")
    )
    return probed.withColumn("companion", companion).withColumns(
        {
            "payload": F.coalesce("payload", "paylow"),
            "paylow": F.when(has_payload, F.col("paylow")),
        }
    )


def companion_errors(resolved: DataFrame) -> DataFrame:
    """Add ``load_error``: split TEX files (``is_d4``) without any payload fail a batch."""
    lost = F.col("is_d4") & (F.col("companion") == "none")
    return resolved.withColumn("load_error", F.when(lost, F.concat(F.lit(rules.LOST_PAYLOAD), F.col("path"))))


def load_attempts(resolved: DataFrame) -> DataFrame:
    """Add ``load_as``: a requested file is loaded with its payloads if it is split (``is_d4``) and has any, else plainly.

    Unlike a batch, a request does not fail for want of a payload.
    """
    split = F.coalesce("is_d4", F.lit(False)) & (F.col("companion") != "none")
    return resolved.withColumns(
        {"load_as": F.when(split, "split").otherwise("plain"), **{c: F.when(split, F.col(c)) for c in ("payload", "paylow")}}
    )


def archive_refs(blobs: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per id with the paths of its parts; packed entries supply metadata last.

    Bytes are left out here: only paths, lengths and offsets are shuffled.
    """
    at = F.instr(F.col("path"), "\\")
    role = F.left(F.col("path"), at - 1)
    ident = F.expr("try_cast(substring(path, instr(path, '\\\\') + 1) AS INT)")
    files = blobs.select(role.alias("role"), ident.alias("sno"), "path", "length").filter(
        F.col("role").isin("base:meta", "base:payload", "base:paylow")
        # The exact name only: "012" and " 12" are other files.
        & (F.col("path") == F.concat("role", F.lit("\\"), F.col("sno").cast("string")))
    )

    def of(role_name, column):
        return F.max(F.when(F.col("role") == role_name, F.col(column)))

    by_id = files.groupBy("sno").agg(
        of("base:meta", "path").alias("id_meta"),
        of("base:meta", "length").alias("id_length"),
        of("base:payload", "path").alias("payload"),
        of("base:payload", "length").alias("payload_length"),
        of("base:paylow", "path").alias("paylow"),
    )
    slices = packed.select("sno", F.col("f").alias("packed_f"), F.col("start").alias("packed_start"),
                           F.col("size").alias("packed_size"))
    return by_id.join(slices, "sno", "left")


def resolve_triplet(toc: DataFrame, blobs: DataFrame, packed: DataFrame, folder: str = "Texture",
                    ext: str = "tex") -> DataFrame:
    """Metadata, payload and low payload of every entry of the table of contents.

    Metadata comes from the path by name, else the path by id, else the packed
    index. Entries without metadata or with a missing or empty payload drop out.
    """
    name_key = F.concat(F.lit(f"Base\\meta\\{folder}\\"), F.col("name"), F.lit(f".{ext}"))
    named = blobs.filter(F.col("path").startswith(f"Base\\meta\\{folder}\\")).groupBy(
        F.col("path").alias("name_meta")
    ).agg(F.max("length").alias("name_length"))
    refs = archive_refs(blobs, packed).filter(F.col("payload_length") > 0)
    joined = toc.join(refs, "sno").withColumn("_key", name_key).join(named, F.col("_key") == F.col("name_meta"), "left")
    meta = F.coalesce("name_meta", "id_meta")
    source = (
        F.when(F.col("name_meta").isNotNull(), "name")
        .when(F.col("id_meta").isNotNull(), "id")
        .when(F.col("packed_f").isNotNull(), "packed")
    )
    length = F.when(F.col("name_meta").isNotNull(), F.col("name_length")).when(
        F.col("id_meta").isNotNull(), F.col("id_length")
    )
    packed_only = source == "packed"
    # The first metadata found decides: if that file is empty, the entry is unreadable.
    usable = joined.filter(source.isNotNull() & F.coalesce(length > 0, F.lit(True)))
    return usable.select(
        F.concat(F.col("name"), F.lit(".tex")).alias("name"),
        "sno",
        source.alias("meta_source"),
        meta.alias("meta"),
        *[F.when(packed_only, F.col(c)).alias(c) for c in ("packed_f", "packed_start", "packed_size")],
        "payload",
        "paylow",
    )


def attach_bytes(triplets: DataFrame, blobs: DataFrame, slices: DataFrame, magic: int) -> DataFrame:
    """Fetch the bytes named by :func:`resolve_triplet`, payload headers stripped.

    ``slices(sno, data)`` holds metadata cut from packed files. The wanted files
    are one narrow table of (path, id, role); a Bloom filter of its paths drops nearly all other contents
    where they are, the join the rest, and one grouping by id brings the parts together. Bytes are exchanged at
    most twice: by path, then by id.
    """
    roles = {"meta": "meta", "payload": "payload", "paylow": "paylow"}
    named = F.array(*[F.struct(F.lit(role).alias("role"), F.col(ref).alias("path")) for ref, role in roles.items()])
    wanted = triplets.select("sno", F.explode(F.filter(named, lambda w: w["path"].isNotNull())).alias("w")).select("sno", "w.role", "w.path").distinct()
    body = F.when(F.col("role") == "meta", F.col("data")).otherwise(strip_header(F.col("data"), magic))
    # Most of an archive is not wanted: its bytes are dropped where they are, not exchanged.
    names = wanted.select("path").distinct()
    near = blobs.select("path", "data").filter(might_contain(names, F.col("path"), names.count()))
    files = near.join(wanted, "path").select("sno", "role", body.alias("data"))
    cut = slices.join(triplets.filter("meta_source = 'packed'").select("sno").distinct(), "sno", "left_semi")
    parts = files.unionAll(cut.select("sno", F.lit("slice").alias("role"), "data"))

    def of(role, name):
        return F.max(F.when(F.col("role") == role, F.col("data"))).alias(name)

    found = parts.groupBy("sno").agg(
        of("meta", "_file"), of("slice", "_slice"), of("payload", "payload_data"), of("paylow", "paylow_data")
    )
    picked = F.when(F.col("meta_source") == "packed", F.col("_slice")).otherwise(F.col("_file"))
    out = triplets.select("name", "sno", "meta_source").join(found, "sno")
    return out.select("name", "sno", picked.alias("data"), "payload_data", "paylow_data").filter(F.length("data") > 0)


def unavailable(toc: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries that resolve to nothing, with the reason shown for them."""
    missing = toc.join(resolved.select("sno").distinct(), "sno", "left_anti")
    return missing.withColumn("message", F.concat(F.lit(rules.UNAVAILABLE), F.col("name")))


def unreadable(listing: DataFrame, blobs: DataFrame) -> DataFrame:
    """Listed regular files that are missing or empty in the archive, with the message shown for them.

    Only path and length are exchanged; readable files leave the join.
    """
    readable = blobs.filter(F.col("length") > 0).select("path")
    lost = listing.select("path").join(readable, "path", "left_anti")
    return lost.withColumn("message", F.concat(F.lit(rules.UNREADABLE), F.col("path")))


def attach_hash(slices: DataFrame, hashes: DataFrame, group: str = rules.TEXTURE_GROUP) -> DataFrame:
    """Add the format hash of ``group`` (0 if it has none) as a one-value subquery."""
    value = hashes.filter(F.col("group_name") == group).agg(F.max("format_hash")).scalar()
    return slices.withColumn("format_hash", F.coalesce(value, F.lit(0)))

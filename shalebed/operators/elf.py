"""Protections of ELF files of an inventory (firmware_id, path, content)."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
EXEC, DYN = 2, 3
LOAD, DYNAMIC, INTERP, STACK, RELRO = 1, 2, 3, 0x6474E551, 0x6474E552
TAG_STRTAB, TAG_SYMTAB, TAG_SONAME, TAG_BIND_NOW, TAG_FLAGS, TAG_FLAGS_1, TAG_HASH = 5, 6, 14, 24, 30, 0x6FFFFFFB, 4
CANARY = {b"__stack_chk_fail", b"__stack_chk_guard", b"__intel_security_cookie"}
ROOT = r"^[a-z0-9]+-root(-\d+)?$"
INFO = "kind string, machine int, static boolean, nx boolean, pie boolean, relro string, canary boolean, malformed string"


def _read(data: bytes) -> tuple:
    """The fields of INFO of one file, by its headers only."""
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    word = "Q" if wide else "I"
    unpack = lambda form, at: struct.unpack_from(order + form, data, at)
    kind, machine, _, _, ph, sh, _, _, ph_size, ph_n, sh_size, sh_n, names = unpack(f"HHI{word * 3}IHHHHHH", 16)
    segments = []
    for i in range(ph_n):
        if wide:
            t, flags, offset, address, _, size, _, _ = unpack("IIQQQQQQ", ph + i * ph_size)
        else:
            t, offset, address, _, size, _, flags, _ = unpack("IIIIIIII", ph + i * ph_size)
        segments.append((t, flags, offset, address, size))
    sections = []
    for i in range(sh_n):
        name, t, _, _, offset, size, link, _, _, entry = unpack(f"II{word * 4}II{word * 2}", sh + i * sh_size)
        sections.append((name, t, offset, size, link, entry))
    tags = []
    dynamic = next((s for s in segments if s[0] == DYNAMIC), None)
    if dynamic:
        step = 16 if wide else 8
        for at in range(dynamic[2], dynamic[2] + dynamic[4], step):
            tag, value = unpack(word * 2, at)
            if not tag:
                break
            tags.append((tag, value))
    have = dict(tags)
    text = lambda at: data[at : data.index(b"\0", at)]
    label = "exec" if kind == EXEC or kind == DYN and any(s[0] == INTERP for s in segments) and TAG_SONAME not in have else "lib" if kind == DYN else "other"
    symbol = lambda at: unpack("IBBHQQ", at)[::3][:2] if wide else (unpack("IIIBBH", at)[0], unpack("IIIBBH", at)[5])

    def imported() -> bool:
        step = 24 if wide else 16
        tables = []
        if sections:
            tables = [(o, s // (e or step), sections[link][2]) for _, t, o, s, link, e in sections if t in (2, 11) and link < len(sections)]
        elif TAG_SYMTAB in have and TAG_STRTAB in have:
            place = lambda a: next((o + a - v for t, _, o, v, s in segments if t == LOAD and v <= a < v + s), None)
            start, strings = place(have[TAG_SYMTAB]), place(have[TAG_STRTAB])
            if start is not None and strings is not None and strings > start:
                tables = [(start, (strings - start) // step, strings)]
        return any(owner == 0 and text(strings + name) in CANARY for o, n, strings in tables for name, owner in (symbol(o + i * step) for i in range(n)))

    bound = TAG_BIND_NOW in have or have.get(TAG_FLAGS, 0) & 8 or have.get(TAG_FLAGS_1, 0) & 1
    got = sh_n and any(text(sections[names][2] + s[0]) == b".got.plt" for s in sections)
    relro = "none" if not any(s[0] == RELRO for s in segments) else "full" if bound or not got else "partial"
    return (
        label, machine, label != "other" and dynamic is None, any(s[0] == STACK and not s[1] & 1 for s in segments), label == "exec" and kind == DYN,
        relro, dynamic is not None and imported(), None,
    )


def _infos(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for data in contents:
        try:
            rows.append(_read(data))
        except Exception as error:  # a broken file is told, not raised
            rows.append((None,) * 7 + (f"{type(error).__name__}: {error}"[:200],))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in INFO.split(", ")])


def elf_info(content: Column) -> Column:
    """struct<INFO> of a binary column."""
    return F.pandas_udf(_infos, INFO)(content)


def under_root(path: Column) -> Column:
    """Whether a relative path lies below a file system root; other folders don't count."""
    folders = F.split(path, "/")
    return F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: x.rlike(ROOT))


def filesystem_features(inventory: DataFrame, key: str = "firmware_id") -> DataFrame:
    """Counts and shares of the ELF files of each image, equal files once.

    Shares have their own denominators (executables and libraries, executables,
    those not static), and are null without one. fs_arch: the most frequent
    machine, the least of equals. fs_status is ok, or erro where a file of the image
    couldn't be read (null content): then all features are null, and fs_error names the
    first such file.

    Files are read where they are; only what was read of them is shuffled.
    """
    files = inventory.where(under_root(F.col("path")))
    elves = files.where(F.substring("content", 1, 4) == F.lit(b"\x7fELF"))
    read = elves.select(key, F.octet_length("content").alias("__size"), F.sha2("content", 256).alias("__sha"), elf_info(F.col("content")).alias("i"))
    info = read.groupBy(key, "__size", "__sha").agg(F.first("i").alias("i")).select(key, "i.*")
    eligible, run = F.col("kind").isin("exec", "lib"), F.col("kind") == "exec"
    share = lambda hit, base: F.try_divide(F.count_if(hit & base).cast("double"), F.count_if(base).cast("double"))
    summed = info.groupBy(key).agg(
        F.count(F.lit(1)).alias("unpacked_n_elf"),
        F.count_if(run).alias("unpacked_n_elf_exec"),
        F.count_if(F.col("kind") == "lib").alias("unpacked_n_elf_lib"),
        F.count_if(eligible & F.col("static")).alias("unpacked_n_elf_static"),
        share(F.col("nx"), eligible).alias("unpacked_prop_nx"),
        share(F.col("pie"), run).alias("unpacked_prop_pie"),
        share(F.col("relro") == "full", eligible).alias("unpacked_prop_relro_full"),
        share(F.col("relro") == "partial", eligible).alias("unpacked_prop_relro_partial"),
        share(F.col("canary"), eligible & ~F.col("static")).alias("unpacked_prop_canary"),
        F.count("malformed").alias("fs_elf_malformed"),
        F.mode("machine", True).alias("fs_arch"),
    )
    unread = F.min(F.when(F.col("content").isNull(), F.col("path")))
    counted = files.groupBy(key).agg(F.count(F.lit(1)).alias("unpacked_n_files"), unread.alias("fs_error"))
    counts = ["unpacked_n_elf", "unpacked_n_elf_exec", "unpacked_n_elf_lib", "unpacked_n_elf_static", "fs_elf_malformed"]
    out = counted.join(summed, key, "left").fillna(0, counts)
    features = [c for c in out.columns if c not in (key, "fs_error")]
    told = out.withColumns({c: F.when(F.col("fs_error").isNull(), F.col(c)) for c in features})
    return told.withColumn("fs_status", F.when(F.col("fs_error").isNull(), "ok").otherwise("erro"))


def inventory_summary(inventory: DataFrame, key: str = "firmware_id") -> DataFrame:
    return inventory.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"), F.bool_or(under_root(F.col("path"))).alias("any_under_root")
    )


def is_encrypted(content: Column) -> Column:
    """The marker of an encrypted image in its first 4,096 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), F.lit("Salted__")) > 0

"""File system roots against a walk over the same tree."""

from __future__ import annotations

import random
import re

from shalebed.operators import roots

SCHEMA = "firmware_id long, path string, kind string, note string"


def walked(rows):
    """(key, root, relative paths) by going down from the top of each image."""
    out = {}
    for key in {r[0] for r in rows}:
        own = {(p, k) for r, p, k, _ in rows if r == key and p is not None and k is not None}
        links = {p for p, k in own if k == "link"} if key is not None else set()
        for path, kind in own:
            folders = path.split("/")[: None if kind == "dir" else -1]
            root = None
            for depth in range(1, len(path.split("/"))):
                if "/".join(path.split("/")[:depth]) in links:
                    break
            else:
                for depth, name in enumerate(folders, 1):
                    if re.fullmatch(r"[a-z0-9]+-root(-[0-9]+)?", name):
                        root = "/".join(folders[:depth])
                        break
            if root is not None and kind != "link":
                found = out.setdefault((key, root), set())
                if kind == "file":
                    found.add(path[len(root) + 1 :])
    return out


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    expected = walked(rows)
    found = roots.find_roots(df).collect()
    assert sorted(map(str, found)) == sorted(
        f"Row(firmware_id={k!r}, root={r!r}, n_files={len(f)}, first_path={min(f, default=None)!r}, last_path={max(f, default=None)!r})" for (k, r), f in expected.items()
    )
    files = {(x.firmware_id, x.root, x.path) for x in roots.root_files(df).collect()}
    assert files == {(k, r, p) for (k, r), f in expected.items() for p in f}
    return expected


def test_roots_of_an_image(spark):
    """Carved files, links, nested roots and roots without files."""
    rows = [
        (1, "x/squashfs-root/bin/app", "file", "a"),
        (1, "x/squashfs-root/bin/app", "file", "b"),
        (1, "x/squashfs-root/shortcut", "link", ""),
        (1, "x/1A0.elf", "file", ""),
        (1, "x/squashfs-root-0/copy", "file", ""),
        (1, "x/squashfs-root/sub/cpio-root/x", "file", ""),
        (1, "link-root", "link", ""),
        (1, "link-root/bin/app", "file", ""),
        (1, "ext-root", "dir", ""),
        (1, "Ext-root/f", "file", ""),
        (1, "my-ext-root/f", "file", ""),
        (1, "ext-root-/f", "file", ""),
        (1, "cpio-root", "file", ""),
        (2, "", "file", ""),
        (2, None, "file", ""),
        (2, "cpio-root/f", None, ""),
        (None, "cpio-root/f", "file", ""),
        (None, "cpio-root", "link", ""),
    ]
    assert set(compared(spark, rows)) == {(1, "x/squashfs-root"), (1, "x/squashfs-root-0"), (1, "ext-root"), (None, "cpio-root")}
    nothing = spark.createDataFrame([], SCHEMA)
    assert roots.find_roots(nothing).count() == roots.root_files(nothing).count() == 0


def test_roots_of_random_trees(spark):
    rng = random.Random(3)
    names = ["a", "b", "squashfs-root", "cpio-root-1", "jffs2-root", "lib"]
    rows = [
        (rng.randrange(4), "/".join(rng.choice(names) for _ in range(rng.randint(1, 6))), rng.choice(["file"] * 6 + ["dir"] * 2 + ["link"]), "")
        for _ in range(400)
    ]
    rows += [(9, "/".join(["deep"] * 300 + ["cpio-root", "f"]), "file", "")]
    assert len(compared(spark, rows)) > 10

"""Which files have their text indexed: by folder, repository, ignore files, name and size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .content import generated
from .ignore import ignored
from .names import folded

# Folders that are generated, vendored or caches wherever they are, outside of repositories.
SKIPPED = (
    "node_modules .git DerivedData __pycache__ .venv venv site-packages Pods .next .turbo .cache Library .build .rustup .cargo .npm .bun .nvm vendor "
    ".pnpm-store coverage .Trash .svn .hg .gradle .m2 .pyenv .rbenv .gem .conda miniconda3 anaconda3 .docker .orbstack .colima .lima .ollama .android .expo "
    ".terraform.d .wrangler .vscode-server"
).split()
#: Folders that are build output or caches only if they hold one of the markers.
MARKED = "target build dist cache Cache caches Caches".split()
MARKERS = "CACHEDIR.TAG CMakeCache.txt build.ninja".split()
#: Folders below home of dependencies or applications' data.
BELOW_HOME = "go/pkg .cursor/extensions .vscode/extensions .local/share .local/state .config/gcloud .codex/.tmp".split()
BUNDLES = ".app .photoslibrary .library .lrlibrary .musiclibrary .tvlibrary .imovielibrary .xcassets .framework .bundle .xcarchive .xcresult .dSYM .salon .lrdata".split()
#: Extensions of files that are never text, in repositories.
BINARY = (
    "png jpg jpeg gif bmp ico webp tiff tif avif heic heif jxl jp2 j2k psd icns cur cr2 nef dng tga rgbe hdr exr dds ktx ktx2 pvr astc ai webarchive mhtml "
    "mp4 avi mov wmv mkv mp3 wav flac ogg m4a aac webm flv mpg mpeg wma opus pcm reapeaks zip tar gz bz2 xz 7z rar zst lz4 lzma cab cpio jsonlz4 deb rpm apk "
    "dmg msi iso nupkg whl egg appimage flatpak crx pak exe dll so dylib o a lib bin elf pdf doc docx xls xlsx ppt pptx db sqlite sqlite3 mdb sqlite-wal "
    "sqlite-shm sqlite3-wal sqlite3-shm db-wal db-shm ldb ttf otf woff woff2 eot class pyc pyo wasm dex jar war cmi cmt cmti cmx nib swiftdeps swiftdeps~ "
    "swiftdoc swiftmodule swiftsourceinfo npy npz h5 hdf5 pt onnx safetensors tfrecord tflite gguf ggml joblib glb blend blp dia bcmap pb parquet arrow suo"
).split()
#: Extensions of text files, outside of repositories.
TEXT = (
    "rs c h cc cpp cxx hpp hh m mm swift go py pyi js mjs cjs ts mts cts tsx jsx java kt kts scala rb php cs fs sh zsh bash fish lua sql html htm css scss "
    "sass less json jsonc json5 yaml yml toml xml vue svelte astro zig nim hs ml mli ex exs erl clj dart r jl md mdx markdown txt text rst org tex csv tsv "
    "ini cfg conf env properties plist metal glsl wgsl hlsl proto graphql gql nix tf hcl gradle cmake mk make dockerfile log jsonl ndjson diff patch srt vtt "
    "rtf svg pl pm ps1 bat vim el lisp scm rkt elm purs sol v sv vhd asm s d cr pas f90 cmd service desktop gitignore editorconfig lock sum"
).split()
MOST, MOST_IN_REPO, MOST_BARE = 1 << 20, 10 << 20, 256 << 10


def extension(name: Column) -> Column:
    """What stands after the last dot that isn't the first character, A-Z folded; empty if there is none."""
    return folded(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def has_extension(name: Column) -> Column:
    return name.rlike(r"^.+\.[^.]*$")


def name_fits(name: Column, size: Column) -> Column:
    """Outside of a repository: a text file's extension, or none and a small size."""
    text = extension(name).isin(TEXT) & ~name.endswith(".min.js") & (name != "package-lock.json")
    return (size <= MOST) & ~name.isin(SKIPPED) & F.when(has_extension(name), text).otherwise(size <= MOST_BARE)


def name_fits_in_repo(name: Column, size: Column) -> Column:
    """In a repository: all but what is binary by name or large."""
    most = F.when(extension(name).isin("json", "jsonl", "ndjson"), MOST).otherwise(MOST_IN_REPO)
    return (size <= most) & (name != ".git") & ~extension(name).isin(BINARY)


def skipped(below: Column, name: Column, marked: Column) -> Column:
    """Whether a folder outside of repositories is left out; below: its path below home; marked: whether it holds a marker."""
    bundle = reduce(lambda a, b: a | b, [name.endswith(x) & (F.length(name) > len(x)) for x in BUNDLES])
    return name.isin(SKIPPED) | bundle | below.isin(BELOW_HOME) | (name.isin(MARKED) & marked)


def repositories(entries: DataFrame, home: str) -> DataFrame:
    """path of the folders that hold a .git, never home itself or the root."""
    return entries.filter((F.col("name") == ".git") & (F.col("parent") != "") & (F.col("parent") != home)).select(F.col("parent").alias("path")).distinct()


def repository_of(paths: DataFrame, entries: DataFrame, home: str) -> DataFrame:
    """path, repo: the deepest folder above that holds a .git; null if none does.

    Folders above are exploded and joined by equality.
    """
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above"))
    above = above.filter(F.col("above") != "")
    best = above.join(repositories(entries, home).withColumnRenamed("path", "above"), "above").groupBy("path").agg(F.max_by("above", F.length("above")).alias("repo"))
    return paths.join(best, "path", "left").select("path", "repo")


def places(entries: DataFrame, home: str, skips: list[str] = [], worktrees: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """folder, in_repo of the folders at or below home that files are indexed from, ignore files aside.

    A folder is out if one on the way from home to it is: by the heuristics for folders that no repository holds, for being a .git in one,
    by a list of skipped folders, or as a linked working tree (worktrees: their paths). Each folder's way is as long as it is deep.
    """
    folders = entries.filter((F.col("parent") == home) | F.col("parent").startswith(home + "/")).select(F.col("parent").alias("folder")).distinct()
    below = F.expr(f"substring(folder, {len(home) + 2})")
    parts = F.split(below, "/")
    steps = F.when(below == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(parts)))
    way = folders.select("folder", F.explode_outer(steps).alias("depth"), parts.alias("parts"))
    way = way.select("folder", "depth", F.array_join(F.slice("parts", F.lit(1), F.coalesce("depth", F.lit(0))), "/").alias("below"))
    way = way.withColumn("above", F.when(F.col("depth").isNotNull(), F.concat(F.lit(home + "/"), "below")))
    held = entries.filter(F.col("name").isin([".git", *MARKERS])).groupBy(F.col("parent").alias("above"))
    held = held.agg(F.bool_or(F.col("name") == ".git").alias("git"), F.bool_or(F.col("name").isin(MARKERS) & (F.col("kind") == 0)).alias("marked"))
    way = way.join(held, "above", "left")
    linked = F.lit(False)
    if worktrees is not None:
        way = way.join(worktrees.select(F.col("path").alias("above"), F.lit(True).alias("linked")), "above", "left")
        linked = F.coalesce("linked", F.lit(False))
    name = F.substring_index("above", "/", -1)
    always = linked | F.col("above").isin(skips) if skips else linked
    step = F.struct("depth", (name == ".git").alias("inside"), skipped(F.col("below"), name, F.coalesce("marked", F.lit(False))).alias("outside"), always.alias("always"))
    by = way.groupBy("folder").agg(F.min(F.when(F.coalesce("git", F.lit(False)), F.col("depth"))).alias("repo"), F.collect_list(F.when(F.col("depth").isNotNull(), step)).alias("steps"))
    out = F.exists("steps", lambda x: x["always"] | F.when(F.col("repo") < x["depth"], x["inside"]).otherwise(x["outside"]))
    return by.filter(~out).select("folder", F.col("repo").isNotNull().alias("in_repo"))


def linked_worktrees(git_files: DataFrame) -> DataFrame:
    """path of the folders whose .git is a file (path, body) that points into another repository's worktrees."""
    target = F.regexp_replace(F.trim(F.regexp_extract("body", r"(?s)^gitdir:(.*)$", 1)), "/$", "")
    return git_files.filter(F.try_element_at(F.reverse(F.split(target, "/")), F.lit(2)) == "worktrees").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))


def wanted(entries: DataFrame, home: str, rules: DataFrame | None = None, skips: list[str] = [], folder: str | None = None, recursive: bool = True, worktrees: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """path, size, mtime of the files whose text is indexed, below a folder (or right in it), by all rules."""
    files = entries.filter(F.col("kind") == 0).join(places(entries, home, skips, worktrees).withColumnRenamed("folder", "parent"), "parent")
    if folder is not None:
        files = files.filter(F.col("path").startswith(folder + "/") if recursive else F.col("parent") == folder)
    name, size = F.col("name"), F.col("size")
    files = files.filter(F.when(F.col("in_repo"), name_fits_in_repo(name, size)).otherwise(name_fits(name, size)) & ~generated(name, size))
    if rules is not None:
        files = files.join(ignored(entries, rules), "path", "left_anti")
    return files.select("path", "size", "mtime")


def resynced(before: DataFrame, after: DataFrame) -> DataFrame:
    """path of the folders whose ignore files changed (size or mtime) between two states of the entries: all below is synced again."""
    rules = lambda e: e.filter(F.col("name").isin(".gitignore", ".ignore") | F.col("path").endswith("/.git/info/exclude")).select("path", "size", "mtime")
    old = rules(before).select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"))
    both = rules(after).join(old, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime").eqNullSafe(F.col("o_mtime"))
    return both.filter(~same).select(F.regexp_replace("path", r"(/\.git/info)?/[^/]*$", "").alias("path")).distinct()

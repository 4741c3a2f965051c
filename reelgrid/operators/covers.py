"""Which picture stands for a film: candidates beside it, named by a sidecar, or in the folder above; the best by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.labels import poster_name
from reelgrid.functions.media import base_name, cover_rank, folder_of, is_picture
from reelgrid.functions.names import parsed_name
from reelgrid.operators.pairing import years_agree

# What pictures of a folder are called, and what may follow a film's name.
FIXED_NAMES, SIDECAR_NAMES, SUFFIXES = ("cover", "poster", "folder", "default"), ("movie",), ("poster", "cover", "folder", "thumb", "art")


def stem(name: Column) -> Column:
    """A picture's name without its extension and one suffix such as -poster."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), f"(?i)(?<=.)[-._ ](?:{'|'.join(SUFFIXES)})$", "")


def indexed(files: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    """files (path) as (path, folder, fixed, key, year)."""
    name = base_name(F.col("path"))
    bare = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    parsed = files.withColumn("_n", parsed_name(F.concat(stem(name), F.lit(".x"))))
    return parsed.select("path", folder_of(F.col("path")).alias("folder"), bare.isin(*fixed).alias("fixed"), F.col("_n.key").alias("key"), F.col("_n.year").alias("year"))


def best_in_folder(films: DataFrame, pictures: DataFrame, folder: str, fixed_when: str) -> DataFrame:
    """(film, picture): the first picture in the folder with the film's key and an agreeing year; else the folder's own, where fixed_when holds.

    films: film, key, year, folder and a boolean column fixed_when.
    """
    p = pictures.select("path", F.col("folder").alias(folder), "key", F.col("year").alias("y"), "fixed")
    named = films.join(p.where("NOT fixed AND key <> ''"), [folder, "key"]).where(years_agree(F.col("year"), F.col("y"))).select("film", F.lit(0).alias("rank"), "path")
    own = p.where("fixed").groupBy(folder).agg(F.min("path").alias("path"))  # one for each folder
    fixed = films.where(F.col(fixed_when)).join(own, folder).select("film", F.lit(1).alias("rank"), "path")
    return named.unionByName(fixed).groupBy("film").agg(F.min(F.struct("rank", "path")).alias("b")).select("film", F.col("b.path").alias("picture"))


def candidates(films: DataFrame, images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(film, source, path) of every candidate. films: film (path), key, year; images, sidecars: path."""
    f = films.withColumn("folder", folder_of(F.col("film"))).withColumn("above", folder_of(F.col("folder")))
    counts = f.groupBy("folder").agg(F.count("*").alias("n"))
    f = f.join(counts, "folder").join(counts.select(F.col("folder").alias("above"), F.lit(True).alias("_held")), "above", "left")
    f = f.withColumns({"alone": F.col("n") == 1, "empty_above": F.col("_held").isNull()})
    pictures = indexed(images, FIXED_NAMES)
    beside = best_in_folder(f, pictures, "folder", "alone").select("film", F.lit("beside").alias("source"), F.col("picture").alias("path"))
    named = best_in_folder(f, indexed(sidecars, SIDECAR_NAMES), "folder", "alone").select("film", F.lit("sidecar").alias("source"), F.col("picture").alias("path"))
    above = best_in_folder(f, pictures, "above", "empty_above").select("film", F.lit("folder-above").alias("source"), F.col("picture").alias("path"))
    return beside.unionByName(named).unionByName(above)


def decided(found: DataFrame, id: str = "film") -> DataFrame:
    """(id, source, path): the candidate of the least rank, the first path among equals."""
    best = F.min(F.struct(cover_rank(F.col("source")).alias("rank"), "path", "source"))
    return found.groupBy(id).agg(best.alias("b")).select(id, "b.source", "b.path")


def chosen(films: DataFrame, found: DataFrame, named: DataFrame) -> DataFrame:
    """(film, cover): what stands for each film now, a struct (path, source) or null.

    films: film, recorded (struct path, source, or null) and opened (whether it carries artwork; null if it wasn't opened).
    found: candidates() (film, source, path); named: thumbs() by sidecar (path, picture). What a person chose stays. Artwork
    inside a film counts as it was recorded where the film wasn't opened. A sidecar is only read where nothing better was
    found, and one that was recorded is kept as it is.
    """
    one = lambda source: found.where(F.col("source") == source).groupBy("film").agg(F.min("path").alias(source.replace("-", "_")))
    rows = films
    for source in ("beside", "sidecar", "folder-above"):
        rows = rows.join(one(source), "film", "left")
    rows = rows.join(named.select(F.col("path").alias("sidecar"), "picture"), "sidecar", "left")
    was = F.col("recorded.source")
    inside = F.coalesce(F.col("opened"), was == "in-file", F.lit(False))
    cover = lambda path, source: F.struct(path.alias("path"), F.lit(source).alias("source"))
    sidecar = F.when(was == "sidecar", F.col("recorded.path")).otherwise(F.col("picture"))
    best = (
        F.when(was == "chosen", F.struct(F.col("recorded.path").alias("path"), was.alias("source"))).when(inside, cover(F.col("film"), "in-file"))
        .when(F.col("beside").isNotNull(), cover(F.col("beside"), "beside")).when(sidecar.isNotNull(), cover(sidecar, "sidecar"))
        .when(F.col("folder_above").isNotNull(), cover(F.col("folder_above"), "folder-above"))
    )
    return rows.select("film", best.alias("cover"))


def from_folder(films: DataFrame, pictures: DataFrame) -> DataFrame:
    """(film, cover): films given the first picture of a folder that has their key and an agreeing year, as chosen.

    films: film, key, year; pictures: path and content (their first bytes are enough). What isn't a picture is passed over.
    """
    named = indexed(pictures.where(is_picture(F.col("content"))).select("path"), ()).where("key <> ''").select("path", "key", F.col("year").alias("y"))
    met = films.join(named, "key").where(years_agree(F.col("year"), F.col("y"))).groupBy("film").agg(F.min("path").alias("path"))
    return met.select("film", F.struct("path", F.lit("chosen").alias("source")).alias("cover"))


def posters_wanted(films: DataFrame, cached: DataFrame, directory: str) -> DataFrame:
    """(id, path, cover): films there are whose cached picture isn't the one they should have, or isn't on the disk (cached: path)."""
    wanted = F.concat(F.lit(directory.rstrip("/") + "/"), poster_name(F.col("path"), F.col("modified_at"), F.col("cover_path")))
    rows = films.where("missing_since IS NULL").withColumn("_wanted", wanted)
    there = cached.select(F.col("path").alias("_wanted"), F.lit(True).alias("_there")).distinct()
    return rows.join(there, "_wanted", "left").where(F.col("_there").isNull() | ~F.col("poster_path").eqNullSafe(F.col("_wanted"))).select("id", "path", F.col("cover_path").isNotNull().alias("cover"))


#: What a sidecar may be: bytes of text and thumb elements that are looked at.
SIDECAR_BYTES, THUMBS = 65_536, 8


def thumbs(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """(path, picture): the first existing picture that a sidecar's text (path, text) names in its first THUMBS thumb elements.

    Texts over SIDECAR_BYTES are refused (refused_sidecars() lists them); URLs and other than pictures are passed over; files: path.
    """
    values = F.slice(F.regexp_extract_all("text", F.lit(r"(?is)<thumb\b[^>]*>(.*?)</thumb>"), 1), 1, THUMBS)
    t = sidecars.where(F.octet_length("text") <= SIDECAR_BYTES).select("path", F.posexplode(values).alias("i", "value"))
    value = F.trim("value")
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(to))
    t = t.withColumn("value", value).where(~F.col("value").contains("://") & F.lower("value").rlike(r"\.(jpg|jpeg|png|webp)$"))
    t = t.withColumn("picture", F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat_ws("/", folder_of(F.col("path")), "value")))
    there = t.join(files.select(F.col("path").alias("picture")), "picture", "left_semi")
    return there.groupBy("path").agg(F.min_by("picture", "i").alias("picture"))


def refused_sidecars(sidecars: DataFrame) -> DataFrame:
    """(path, reason) of sidecars (path, text) that thumbs() doesn't read, or not whole."""
    n = F.regexp_count("text", F.lit(r"(?is)<thumb\b"))
    reason = F.when(F.octet_length("text") > SIDECAR_BYTES, "too-large").when(n > THUMBS, "more-thumbs")
    return sidecars.select("path", reason.alias("reason")).where("reason IS NOT NULL")

"""Corpus scans: listings of files, and the annotations beside them, as manifests.

A scan is data: how a path is taken apart, which rows count, and what their columns are. :func:`scan` applies it to a
listing (``path``, ``duration_s``, ``sha1``) and its annotations. A scan for another corpus is another :class:`Scan`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import catalog as C


def name_of(path: str = "path") -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def folder(path: str = "path", up: int = 1) -> Column:
    """The name of the folder ``up`` levels above the file."""
    return F.coalesce(F.element_at(F.split(path, "/"), -1 - up), F.lit(""))


@dataclass(frozen=True)
class Scan:
    """What makes a listing's rows a corpus. Columns that are not given are blank; ``split`` is by group's hash unless set."""

    corpus: str
    kind: str
    licence: Column | str
    group: Column
    item: Column
    speaker: Column = field(default_factory=lambda: F.lit(""))
    noise_class: Column = field(default_factory=lambda: F.lit(""))
    where: Column = field(default_factory=lambda: F.lit(True))
    split: str | None = None
    most_hours: float | None = None


def listing(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length) of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", "length")


def scan(files: DataFrame, spec: Scan) -> DataFrame:
    """The manifest rows of a listing, in path order up to the hours that are wanted."""
    rows = files.filter(F.coalesce(spec.where, F.lit(False)))
    group = F.concat(F.lit(f"{spec.corpus}-"), spec.group)
    licence = spec.licence if isinstance(spec.licence, Column) else F.lit(spec.licence)
    rows = rows.select(
        F.concat(F.lit(f"{spec.corpus}:"), spec.item).alias("source_id"), F.lit(spec.corpus).alias("corpus"), F.lit(spec.kind).alias("kind"), group.alias("group_id"), spec.speaker.alias("speaker_id"),
        S.posix("path").alias("path"), F.col("duration_s").cast("double").alias("duration_s"), licence.alias("licence"), (F.lit(spec.split) if spec.split else S.split_of(group)).alias("split"),
        F.coalesce(F.col("sha1"), F.lit("")).alias("sha1"), spec.noise_class.alias("noise_class"),
    )
    if spec.most_hours is not None:
        rows = C.running_total_below(rows, ["corpus"], ["path"], "duration_s", spec.most_hours * 3600).drop("before")
    return rows


def chosen(value: Column, names: dict[str, str]) -> Column:
    """A value's class by a table of names; null where it has none, so that ``where`` can leave it out."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)


def annotated(files: DataFrame, notes: DataFrame, key: Column, on: str) -> DataFrame:
    """A listing with the annotations whose ``on`` is the row's key; rows without one are left out."""
    return files.withColumn(on, key).join(notes, on)


def without_labels(rows: DataFrame, labels: DataFrame, drop: list[str], digits: int = 11) -> DataFrame:
    """Rows whose name does not begin with a clip id that carries one of the labels (clip, labels array)."""
    bad = labels.filter(F.arrays_overlap("labels", F.array(*map(F.lit, drop)))).select(F.col("clip").alias("__clip")).distinct()
    return rows.withColumn("__clip", F.substring(name_of(), 1, digits)).join(bad, "__clip", "left_anti").drop("__clip")


def microphone_pairs(measured: DataFrame, lo: float, hi: float) -> DataFrame:
    """Channels (a before b) of one recording whose spacing by their coherence's null lies in a range."""
    spacing = F.lit(343.0) / (2 * F.col("null_hz"))
    return measured.filter((F.col("a") < F.col("b")) & spacing.between(lo, hi)).withColumn("spacing_m", spacing)


def only_in(files: DataFrame, key: Column, of: Column) -> DataFrame:
    """Rows whose key occurs with ``of`` and never without it: recordings that only one device made."""
    marked = files.withColumn("__k", key).withColumn("__of", of)
    keys = marked.filter("__of").select("__k").subtract(marked.filter("not __of").select("__k"))
    return marked.filter("__of").join(keys, "__k", "left_semi").drop("__k", "__of")


def joined_classes(rows: DataFrame, by: list[str], order: str, samples: str) -> DataFrame:
    """One signal a class: its recordings' samples in order, end to end. Classes are held out whole, and small."""
    return rows.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, samples))), lambda r: r[samples])).alias(samples))


def first_label(labels: Column, wanted: list[str]) -> Column:
    """Of a row's labels, in their own order, the first that is wanted; null where none is."""
    return F.get(F.filter(labels, lambda x: x.isin(wanted)), 0)


# Scans of public corpora, by how their files are named. Folder grammar, class names and licences.


def speech_by_speaker(corpus: str, licence: str, most_hours: float | None = None) -> Scan:
    """``speaker/chapter/utterance``: read speech grouped by its speaker."""
    return Scan(corpus, "speech", licence, folder(up=2), name_of(), folder(up=2), most_hours=most_hours)


def speech_by_prefix(corpus: str, licence: str, least_snr: float | None = None) -> Scan:
    """``speaker_utterance``: the speaker is what stands before the first underscore."""
    speaker = F.split(name_of(), "_")[0]
    where = F.col("snr_db") >= least_snr if least_snr is not None else F.lit(True)
    return Scan(corpus, "speech", licence, speaker, name_of(), speaker, where=where)


def noise_by_folder(corpus: str, licence: str, classes: dict[str, str], split: str | None = None) -> Scan:
    """``class/recording``: noise whose folder says what it is; folders that are not named are left out."""
    kind = chosen(folder(), classes)
    return Scan(corpus, "noise", licence, S.without_chunk(name_of()), F.concat_ws("/", folder(), name_of()), noise_class=kind, where=kind.isNotNull(), split=split)


def noise_by_label(corpus: str, licence: Column | str, label: str, classes: dict[str, str], group: Column) -> Scan:
    """Noise whose class an annotation names."""
    kind = chosen(F.col(label), classes)
    return Scan(corpus, "noise", licence, group, F.concat_ws("/", F.col(label), name_of()), noise_class=kind, where=kind.isNotNull())


def shots_by_event(corpus: str, licence: str) -> Scan:
    """``event_channel``: all channels of one shot stay in one split."""
    return Scan(corpus, "impulse", licence, F.split(name_of(), "_")[0], name_of(), noise_class=F.lit("impulsive"))


def measured_or_impulsive(label: str, impulsive: list[str]) -> Column:
    """A label that is always impulsive, or the class measured from the signal."""
    return F.when(F.col(label).isin(impulsive), "impulsive").otherwise(F.col("measured_class"))


def noise_but(corpus: str, licence: str, label: str, left_out: list[str], impulsive: list[str], group: Column) -> Scan:
    """Noise of every label but some; a row without a label is left out."""
    return Scan(corpus, "noise", licence, group, F.concat_ws("/", F.col(label), name_of()), noise_class=measured_or_impulsive(label, impulsive), where=~F.col(label).isin(left_out))


def noise_among(corpus: str, label: str, wanted: list[str], impulsive: list[str], group: Column) -> Scan:
    """Noise of the wanted labels (see :func:`first_label`) whose own licence is free; ``file_licence`` null is not."""
    where = F.col(label).isin(wanted) & S.licence_allows("file_licence")
    return Scan(corpus, "noise", F.col("file_licence"), group, F.concat_ws("/", F.col(label), name_of()), noise_class=measured_or_impulsive(label, impulsive), where=where)


def held_back(corpus: str, licence: str, split: str, reserved: str) -> Scan:
    """``split/session_utterance`` of one split. The reserved split is refused: what a manifest holds is no longer unseen."""
    if split == reserved:
        raise ValueError(f"{corpus} {reserved} is held back for tests of generalisation")
    session = F.split(name_of(), "_")[0]
    return Scan(corpus, "noise", licence, session, F.concat_ws(":", F.lit(split), name_of()), noise_class=F.col("measured_class"), where=folder() == split)


# Categories and labels that the manifests keep or leave out.
ESC50_VOCAL = ["crying_baby", "sneezing", "coughing", "laughing", "breathing", "snoring"]
ESC50_IMPULSIVE = ["fireworks", "mouse_click", "can_opening", "footsteps", "keyboard_typing", "clock_tick"]
FSD50K_LABELS = ["Gunshot_and_gunfire", "Explosion", "Siren", "Wind", "Helicopter", "Engine", "Vehicle", "Aircraft", "Crowd", "Chatter"]
FSD50K_IMPULSIVE = ["Gunshot_and_gunfire", "Explosion"]

SCANS = {
    "librispeech": lambda: speech_by_speaker("ls", "CC BY 4.0"), "librittsr": lambda: speech_by_speaker("ltr", "CC BY 4.0", 100.0), "dns_speech": lambda: speech_by_prefix("dns", "CC BY 4.0"),
    "ears": lambda: Scan("ears", "speech", "CC BY-NC 4.0", folder(), F.concat_ws("/", folder(), name_of()), folder(), where=~F.lower(name_of()).rlike("^(nonverbal|vegetative|interjection)")),
    "commonvoice_hi": lambda: Scan("cv-hi", "speech", "CC0 1.0", F.substring("client_id", 1, 16), name_of(), F.substring("client_id", 1, 16), where=F.col("snr_db") >= 30.0),
    "lombard_grid": lambda: Scan("lg", "speech", "CC BY 4.0", F.split(name_of(), "_")[0], name_of(), F.split(name_of(), "_")[0], where=name_of().rlike("^s[0-9]+_[lp]_")),
    "dns_noise": lambda: Scan("dns_noise", "noise", "CC BY 4.0", S.without_chunk(name_of()), name_of(), noise_class=F.col("measured_class")),
    "wham": lambda split="tr": held_back("wham", "CC BY-NC 4.0", split, reserved="tt"),
    "demand": lambda: Scan("demand", "noise", "CC BY 4.0", folder(), F.concat_ws("/", folder(), name_of()), noise_class=F.col("measured_class"), where=name_of().isin("ch01", "ch05")),
    "musan": lambda: Scan("musan", "noise", F.coalesce(F.col("file_licence"), F.lit("public domain")), name_of(), name_of(), noise_class=F.col("measured_class"), where=folder(up=2) == "noise"),
    "esc50": lambda: noise_but("esc50", "CC BY-NC 3.0", "category", ESC50_VOCAL, ESC50_IMPULSIVE, F.col("src_file")),
    "mad": lambda: noise_by_label("mad", "see source videos", "label", {"shooting": "changing", "shelling": "changing", "footsteps": "changing", "vehicle": "stationary", "helicopter": "stationary", "fighter": "stationary"}, F.coalesce(F.nullif(S.youtube_id("url"), F.lit("")), folder())),
    "fsd50k": lambda: noise_among("fsd50k", "label", FSD50K_LABELS, FSD50K_IMPULSIVE, F.coalesce("uploader", F.concat(F.lit("clip"), name_of()))),
    "drone": lambda: noise_by_folder("drone", "see repository", {"drone": "stationary", "membo": "stationary"}), "avq_drone": lambda: noise_by_folder("avq_drone", "CC BY 4.0", {"ego-noise": "stationary"}),
    "noisex92": lambda: Scan("noisex92", "noise", "research only", name_of(), name_of(), noise_class=F.col("measured_class"), where=F.col("cutoff_ratio") < 6.0),
    "vehicle_interior": lambda: noise_by_folder("vehicle_interior", "CC BY 4.0", {"engine": "stationary", "tyre": "stationary", "wind": "stationary"}, split="test"),
    "gunshots": lambda: shots_by_event("gunshots", "CC BY 4.0"), "cadre": lambda: Scan("cadre", "impulse", "public domain", name_of(), name_of(), noise_class=F.lit("impulsive"), where=~folder().isin("readme", "silence")),
    "c3gd": lambda: Scan("c3gd", "impulse", "CC BY 4.0", F.regexp_extract(name_of(), r"^(.*?)_[^_]+$", 1), name_of(), noise_class=F.lit("impulsive")),
    "but_reverbdb": lambda: Scan("but", "rir", "CC BY 4.0", folder(up=3), F.concat_ws("/", folder(up=3), folder(up=2), name_of()), where=F.col("path").contains("/RIR/")),
}


def chunk_index(rows: DataFrame) -> DataFrame:
    """Adds the place of each chunk within its recording."""
    w = Window.partitionBy(S.without_chunk(name_of())).orderBy("path")
    return rows.withColumn("chunk", F.row_number().over(w) - 1)

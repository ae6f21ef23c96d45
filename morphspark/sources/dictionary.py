"""Dictionaries as tables: building them from sources, saving, loading, adding user words, compiling for the workers."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphspark.functions import kernel, normalize
from morphspark.functions.chars import BITS, CharTable, compile_ranges, default_ranges

from .config import Config, ConfigError
from .config import edition as edition_folder
from .formats import LEXICON, REQUIRED, BuildError, lexicon_rows, parse_characters, parse_rewrites, parse_unknown, read_lexicon, read_matrix, small_file, unescaped

LEXICON_TABLE = "dic_id int, word_no int, word_id long, surface string, surface_bytes int, indexed boolean, left_id int, right_id int, cost int, headword string, pos_id int, reading string, normalized string, dic_form_word_id long, unit string, split_a array<long>, split_b array<long>, structure array<long>, synonyms array<int>"
POS = [f"p{k}" for k in range(1, 7)]
MOST_UNITS, MOST_USERS, MOST_WORDS, MOST_POS, MOST_TEXT, MOST_DESCRIPTION = 127, 14, 0x0FFFFFFE, 32767, 32767, 256
AUTO_COST, AUTO_PENALTY = -32768, 20
OWN = 1 << 28


@dataclass
class Dictionary:
    """tables: lexicon, pos, conn; definitions: what plug-ins need besides; meta: description, time, sizes, kind."""

    tables: dict[str, DataFrame]
    meta: dict[str, Any]
    ranges: list[tuple[int, int, int]] = field(default_factory=default_ranges)
    categories: list[tuple[str, bool, bool, int]] = field(default_factory=list)
    unknown: list[tuple[str, int, int, int, tuple[str, ...]]] = field(default_factory=list)
    rewrites: dict[str, str] = field(default_factory=dict)
    exempt: set[str] = field(default_factory=set)
    config: Config = field(default_factory=Config)
    _compiled: kernel.Compiled | None = None
    _broadcast: Any = None

    @property
    def spark(self) -> SparkSession:
        return self.tables["pos"].sparkSession

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    # Storage

    def save(self, folder: str, mode: str = "errorifexists") -> None:
        """Writes each table as Parquet and the rest as one line of JSON."""
        for name, t in self.tables.items():
            t.write.mode(mode).parquet(f"{folder}/{name}")
        rest = {"meta": self.meta, "ranges": self.ranges, "categories": self.categories, "unknown": self.unknown, "rewrites": self.rewrites, "exempt": sorted(self.exempt), "config": self.config.as_json()}
        self.spark.createDataFrame([(json.dumps(rest, ensure_ascii=False),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/meta")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, config: Config | dict | str | None = None, kind: str | None = None) -> Dictionary:
        """A saved dictionary, with another configuration laid over its own; ConfigError if it isn't of the kind asked for (system or user)."""
        row = spark.read.text(f"{folder}/meta").first()
        if row is None:
            raise ConfigError(f"no dictionary in {folder}")
        rest = json.loads(row[0])
        if kind and rest["meta"]["kind"] != kind:
            raise ConfigError(f"{folder} holds a {rest['meta']['kind']} dictionary")
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("lexicon", "pos", "conn")}
        unknown = [(c, a, b, n, tuple(p)) for c, a, b, n, p in rest["unknown"]]
        d = cls(tables, rest["meta"], [tuple(r) for r in rest["ranges"]], [tuple(c) for c in rest["categories"]], unknown, rest["rewrites"], set(rest["exempt"]), Config.of(config).over(Config.of(rest["config"])))
        return d.with_files() if config is not None else d

    @classmethod
    def open(cls, spark: SparkSession, config: Config | dict | str | None = None, resources: str | None = None, dictionary: str | None = None, kind: str | None = None) -> Dictionary:
        """The dictionary that a configuration names, with its definition files and its users' words.

        config: a Config, a dict, JSON or the path of a JSON file. The system
        dictionary is `dictionary` (a folder, or the name of an edition), else the edition
        `kind`, else what the configuration names. Names of files are looked
        for as Config.find says, resources being the resource folder.
        """
        c = Config.of(config)
        if dictionary and kind:
            raise ConfigError("either a dictionary or an edition")
        name = dictionary or kind or c.system
        if not name:
            raise ConfigError("the configuration names no system dictionary")
        try:
            folder = c.find(name, resources) if name != kind else edition_folder(name)
        except ConfigError:
            folder = edition_folder(name)
        d = cls.load(spark, folder, c.update(resources=resources or c.resources), kind="system")
        for path in c.user:
            d = d.with_user(cls.load(spark, c.find(path, resources), kind="user"))
        return d

    def with_files(self) -> Dictionary:
        """This dictionary with what the definition files of its configuration say: character classes (characterDefinitionFile, or a plug-in's charDef), unknown words (unkDef) and rewrite rules (rewriteDef)."""
        c, found = self.config, {}
        lines = lambda name: small_file(self.spark, c.find(name, c.resources))
        of = lambda plugins, key: next((s[key] for s in plugins if s.get(key)), None)
        if name := c.characters or of(c.unknown, "charDef"):
            ranges, kinds = parse_characters(lines(name))
            found |= {"ranges": ranges, "categories": kinds or self.categories}
        if c.characters and (name := of(c.unknown, "charDef")):
            found["categories"] = parse_characters(lines(name))[1] or found["categories"]
        if name := of(c.unknown, "unkDef"):
            found["unknown"] = parse_unknown(lines(name), self.meta["rights"], self.meta["lefts"])
        if name := of(c.normalizers, "rewriteDef"):
            found["rewrites"], found["exempt"] = parse_rewrites(lines(name))
        return replace(self, tables=dict(self.tables), _compiled=None, _broadcast=None, **found) if found else self

    def __repr__(self) -> str:
        return f"<Dictionary {self.meta['kind']} ({self.meta['description']}): {self.meta['words']} words, {self.meta.get('users', 0)} user dictionaries>"

    # Composition

    def part_of_speech(self) -> list[tuple[str, ...]]:
        """All part-of-speech tuples by id."""
        if "pos_list" not in self.__dict__:
            self.pos_list = [tuple(r) for r in self.tables["pos"].orderBy("pos_id").select(*POS).collect()]  # at most MOST_POS
        return self.pos_list

    def pos_id(self, pos: tuple[str, ...] | list[str], user: str = "forbid") -> int:
        """The id of a tuple. user="allow": a new tuple gets the next id."""
        have = self.part_of_speech()
        pos = tuple(pos)
        if pos in have:
            return have.index(pos)
        if user != "allow":
            raise ConfigError(f"no such part of speech: {pos}")
        if len(pos) != 6 or len(have) >= MOST_POS:
            raise ConfigError(f"can't register {pos}")
        have.append(pos)
        self.tables["pos"] = self.tables["pos"].unionByName(self.spark.createDataFrame([(len(have) - 1, *pos)], self.tables["pos"].schema))
        return len(have) - 1

    def with_config(self, config: Config | dict | str) -> Dictionary:
        return Dictionary(dict(self.tables), self.meta, self.ranges, self.categories, self.unknown, self.rewrites, self.exempt, Config.of(config).over(self.config))

    def with_user(self, user: Dictionary) -> Dictionary:
        """This dictionary and a user's words. Words with AUTO_COST get their cost from an analysis with what was there before."""
        users = self.meta.get("users", 0) + 1
        if users > MOST_USERS:
            raise ConfigError(f"at most {MOST_USERS} user dictionaries")
        base_pos = user.meta["system_pos"]
        shift = len(self.part_of_speech()) - base_pos
        own = lambda c: F.when(c >= OWN, c.bitwiseAND(OWN - 1) + OWN * users).otherwise(c)
        lex = user.tables["lexicon"].withColumn("dic_id", F.lit(users)).withColumn("word_id", F.col("word_no").cast("long") + OWN * users)
        for c in ("split_a", "split_b", "structure"):
            lex = lex.withColumn(c, F.transform(c, own))
        lex = lex.withColumn("dic_form_word_id", own(F.col("dic_form_word_id"))).withColumn("pos_id", F.when(F.col("pos_id") >= base_pos, F.col("pos_id") + shift).otherwise(F.col("pos_id")))
        if lex.where(F.col("cost") == AUTO_COST).limit(1).count():
            held = self.broadcast()

            @F.udf("int")
            def price(headword: str) -> int:  # a user's words only, once, at build time
                cost, n = held.value.internal_cost(headword)
                return max(-32768, min(32767, cost - AUTO_PENALTY * n))

            lex = lex.withColumn("cost", F.when(F.col("cost") == AUTO_COST, price("headword")).otherwise(F.col("cost")))
        pos = user.tables["pos"].where(F.col("pos_id") >= base_pos).withColumn("pos_id", F.col("pos_id") + shift)
        tables = self.tables | {"lexicon": self.tables["lexicon"].unionByName(lex), "pos": self.tables["pos"].unionByName(pos)}
        return Dictionary(tables, self.meta | {"users": users}, self.ranges, self.categories, self.unknown, self.rewrites, self.exempt, self.config)

    # Compilation

    def edited_conn(self) -> DataFrame:
        """The connection table after the cost edits of the configuration."""
        conn = self.tables["conn"]
        for s in self.config.connection:
            conn = self._plugin("connection", s)(conn)
        return conn

    def compiled(self) -> kernel.Compiled:
        """What workers hold, collected once: the lexicon and matrix are bounded by 28-bit word ids and 15-bit connection ids."""
        if self._compiled is None:
            n, m = self.meta["lefts"], self.meta["rights"]
            conn = np.zeros((n, m), np.int16)
            got = self.edited_conn().toArrow()
            conn[got.column("left").to_numpy(), got.column("right").to_numpy()] = got.column("cost").to_numpy()
            normalizers = [self._plugin("normalizer", s) for s in self.config.normalizers]
            unknown = [self._plugin("unknown", s) for s in self.config.unknown]
            rewriters = [self._plugin("rewriter", s) for s in self.config.rewriters]
            cols = ["dic_id", "word_no", "word_id", "surface", "surface_bytes", "left_id", "right_id", "cost", "headword", "pos_id", "normalized", "dic_form_word_id", "reading", "split_a", "split_b", "structure", "synonyms"]
            rows = self.tables["lexicon"].select(*cols).toArrow().sort_by([("dic_id", "ascending"), ("word_no", "ascending")]).to_pylist()
            lexicons: list[list[tuple]] = [[] for _ in range(self.meta.get("users", 0) + 1)]
            heads = {r["word_id"]: r["headword"] or r["surface"] for r in rows}
            infos = {}
            for r in rows:
                lexicons[r["dic_id"]].append((r["word_id"], r["surface"], r["left_id"], r["right_id"], r["cost"]))
                head = heads[r["word_id"]]
                base = heads.get(r["dic_form_word_id"], "") if r["dic_form_word_id"] is not None else ""
                infos[r["word_id"]] = (head, r["surface_bytes"], r["pos_id"], r["normalized"] or "", base, r["reading"] or "", *(tuple(r[c] or ()) for c in ("split_a", "split_b", "structure", "synonyms")))
            self._compiled = kernel.Compiled(lexicons, infos, conn, self.part_of_speech(), CharTable(self.ranges), normalizers, unknown, rewriters)
        return self._compiled

    def broadcast(self):
        """The compiled dictionary on all workers; its size is that of the dictionary, whatever the corpus."""
        if self._broadcast is None:
            self._broadcast = self.spark.sparkContext.broadcast(self.compiled())
        return self._broadcast

    def close(self) -> None:
        """Frees the workers' copies."""
        if self._broadcast is not None:
            self._broadcast.unpersist()
            self._broadcast = None

    def _ids(self, s: dict) -> tuple[int, int, int]:
        left, right, cost = s["leftId"], s["rightId"], s["cost"]
        if not (0 <= left < self.meta["rights"] and 0 <= right < self.meta["lefts"] and -32768 <= cost <= 32767):
            raise ConfigError(f"connection ids or cost out of range: {left}, {right}, {cost}")
        return left, right, cost

    def _plugin(self, kind: str, s: dict):
        make = _REGISTRY[kind].get(_short(s))
        if make is None:
            raise ConfigError(f"no such {kind} plug-in: {s['class']}")
        return make(self, s)


def _short(s: dict) -> str:
    """A plug-in's name, without package, prefix and suffix, in any spelling."""
    name = s["class"].rsplit(".", 1)[-1].rsplit("/", 1)[-1].replace("_", "").lower()
    return name[:-6] if name.endswith("plugin") else name[:-8] if name.endswith("provider") else name


def _category(d: Dictionary, s: dict) -> kernel.CategoryUnknown:
    rows: dict[int, list] = {}
    for name, left, right, cost, pos in d.unknown:
        rows.setdefault(BITS[name], []).append((*d._ids({"leftId": left, "rightId": right, "cost": cost}), d.pos_id(pos, s.get("userPOS", "forbid"))))
    return kernel.CategoryUnknown({BITS[c]: (i, g, n) for c, i, g, n in d.categories}, rows)


#: name -> factory(dictionary, settings). Settings may use "characters" and so on of the dictionary.
_REGISTRY: dict[str, dict[str, Any]] = {
    "connection": {
        "inhibitconnection": lambda d, s: lambda conn: inhibit(conn, sorted({tuple(p) for p in s["inhibitPair"]})) if s["inhibitPair"] else conn,
    },
    "normalizer": {
        "defaultinputtext": lambda d, s: normalize.DefaultNormalizer(d.rewrites, d.exempt),
        "prolongedsoundmark": lambda d, s: normalize.ProlongedMarks("".join(s.get("prolongedSoundMarks", "ー-⁓〜〰")), s.get("replacementSymbol", "ー")),
        "ignoreyomigana": lambda d, s: normalize.IgnoreReadings(CharTable(d.ranges), "".join(s.get("leftBrackets", "(（")), "".join(s.get("rightBrackets", ")）")), s.get("maxYomiganaLength", 4)),
    },
    "unknown": {
        "simpleoov": lambda d, s: kernel.SimpleUnknown(d.pos_id(s["oovPOS"], s.get("userPOS", "forbid")), *d._ids(s)),
        "mecaboov": _category,
        "regexoov": lambda d, s: kernel.RegexUnknown(s["regex"], d.pos_id(s["oovPOS"], s.get("userPOS", "forbid")), *d._ids(s), s.get("maxLength", 32), s.get("boundaries", "strict") == "strict"),
    },
    "rewriter": {
        "joinnumeric": lambda d, s: kernel.JoinNumerals(d.pos_id(("名詞", "数詞", *"****")), s.get("enableNormalize", True)),
        "joinkatakanaoov": lambda d, s: kernel.JoinKatakana(d.pos_id(s["oovPOS"]), s.get("minLength", 1)),
    },
}


def register_plugin(kind: str, name: str, factory) -> None:
    """Adds a plug-in: kind is connection, normalizer, unknown or rewriter; factory(dictionary, settings) returns an object with the methods of the built-in ones. One for connections is a function from the table (left, right, cost) to the edited one."""
    _REGISTRY[kind][name.replace("_", "").lower()] = factory


def inhibit(conn: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The connection table with these (left, right) pairs at the highest cost: dear, not forbidden."""
    edits = conn.sparkSession.createDataFrame([(int(a), int(b)) for a, b in pairs], "left int, right int").withColumn("edit", F.lit(kernel.INHIBITED).cast("short"))
    return conn.join(F.broadcast(edits), ["left", "right"], "left").select("left", "right", F.coalesce("edit", "cost").cast("short").alias("cost"))  # edits come from a setting


# Building


def typed_lexicon(raw: DataFrame) -> DataFrame:
    """(word_no, fields by type, texts unescaped) of a raw lexicon in its order."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in LEXICON]
    plain = raw.select("at", *[(t if c in ("left_id", "right_id", "cost") else unescaped(t)).alias(c) for c, t in zip(LEXICON, text)], (sum(F.col(c).isNotNull().cast("int") for c in LEXICON)).alias("fields"))
    number = lambda c: F.expr(f"try_cast({c} as int)").alias(c)
    nothing = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "*")
    units = lambda c: F.when(nothing(c), F.array().cast("array<string>")).otherwise(F.split(c, "/")).alias(c)
    numbered = plain.withColumn("word_no", (F.row_number().over(Window.orderBy("at")) - 1).cast("int"))  # a dictionary, never a corpus
    return numbered.select("word_no", "fields", "surface", number("left_id"), number("right_id"), number("cost"), "headword", *POS, "reading", "normalized", "dictionary", "unit", units("split_a"), units("split_b"), units("structure"), units("synonyms"))


def lexicon_errors(lex: DataFrame, lefts: int, rights: int, words: int, system_words: int | None = None) -> DataFrame:
    """(line, error) of the rows that break a rule. words: of this lexicon; system_words: of the one it adds to."""
    bad_ref = lambda x: F.when(x.rlike("^U[0-9]+$"), F.substring(x, 2, 12).cast("long") >= words).when(x.rlike("^[0-9]+$"), x.cast("long") >= (words if system_words is None else system_words)).otherwise(F.lit(False))
    small = lambda c, n: F.col(c).between(-1, n - 1)
    odd_units = lambda c: F.exists(c, lambda x: ~x.rlike("^U?[0-9]+$") & (F.size(F.split(x, ",")) != 8))
    rules = [
        ("too few fields", F.col("fields") < REQUIRED),
        ("empty surface", F.col("surface") == ""),
        ("text too long", F.greatest(*[F.length(c) for c in ("surface", "headword", "reading", "normalized")]) > MOST_TEXT),
        ("bad number", F.col("left_id").isNull() | F.col("right_id").isNull() | F.col("cost").isNull()),
        ("connection id out of range", ~small("left_id", rights) | ~small("right_id", lefts)),
        ("cost out of range", ~F.col("cost").between(-32768, 32767)),
        ("bad split unit", ~F.col("unit").isin("A", "B", "C", "*", "BC")),
        ("A unit with parts", (F.col("unit") == "A") & ((F.size("split_a") > 0) | (F.size("split_b") > 0))),
        ("too many units", F.greatest(*[F.size(c) for c in ("split_a", "split_b", "structure", "synonyms")]) > MOST_UNITS),
        ("bad split", odd_units("split_a") | odd_units("split_b") | F.exists("structure", lambda x: ~x.rlike("^U?[0-9]+$"))),
        ("bad dictionary form", ~F.col("dictionary").rlike("^U?[0-9]+$") & ~F.col("dictionary").isin("*", "")),
        ("bad synonym group", F.exists("synonyms", lambda x: F.expr("false") | ~x.rlike("^[0-9]{1,10}$"))),
        ("reference out of range", F.exists(F.concat("split_a", "split_b", "structure", F.array("dictionary")), bad_ref)),
    ]
    error = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])
    return lex.select((F.col("word_no") + 1).alias("line"), error.alias("error")).where("error is not null")


def intern_pos(lex: DataFrame, known: DataFrame | None) -> DataFrame:
    """(pos_id, p1..p6): the known tuples, then new ones in the order of their first words."""
    new = lex.groupBy(*POS).agg(F.min("word_no").alias("first"))
    start = 0
    if known is not None:
        start = known.count()
        new = new.join(known, POS, "left_anti")
    new = new.select((F.row_number().over(Window.orderBy("first")) - 1 + start).cast("int").alias("pos_id"), *POS)
    return new if known is None else known.select("pos_id", *POS).unionByName(new)


def resolve_units(lex: DataFrame, column: str, own: DataFrame, system: DataFrame | None, dic: int) -> DataFrame:
    """(word_no, units, missing): the word ids of a column of references. own and system: (word_id, surface, headword, p1..p6, reading).

    A number names a word of the system, or of this lexicon while that is
    being built; U and a number one of this lexicon; surface, six classes and
    reading the first such word, of this lexicon by its surface before the
    system's by its headword. A reading equal to that key counts as none.
    """
    refs = lex.select("word_no", F.posexplode(column).alias("k", "ref"))
    part = F.split("ref", ",")
    inline = refs.where("ref like '%,%'").select("word_no", "k", part[0].alias("key"), *[part[i].alias(p) for i, p in enumerate(POS, 1)], F.when(part[7] == part[0], "").otherwise(part[7]).alias("reading"))
    want = inline.select("key", *POS, "reading").distinct()

    def words(t: DataFrame, key: str) -> DataFrame:
        k = F.when(F.col(key) == "", F.col("surface")).otherwise(F.col(key)) if key == "headword" else F.col(key)
        return t.select("word_id", k.alias("key"), *POS, F.when(F.col("reading") == k, "").otherwise(F.coalesce("reading", F.lit(""))).alias("reading"))

    on = ["key", *POS, "reading"]
    found = want.join(words(own, "surface"), on, "left").groupBy(*on).agg(F.min("word_id").alias("own"))
    if system is not None:
        found = found.join(words(system, "headword").groupBy(*on).agg(F.min("word_id").alias("sys")), on, "left")
    found = found.select(*on, F.coalesce(*(["own", "sys"] if system is not None else ["own"])).alias("id"))
    plain = refs.where("ref not like '%,%'").select("word_no", "k", F.when(F.col("ref").startswith("U"), F.substring("ref", 2, 12).cast("long") + dic * OWN).otherwise(F.col("ref").cast("long")).alias("id"))
    every = plain.unionByName(inline.join(found, on, "left").select("word_no", "k", "id"))
    return every.groupBy("word_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("units"), F.max(F.col("id").isNull()).alias("missing"))


class DictionaryBuilder:
    """Builds a system dictionary, or a user's over a system's: read_conn, read_lexicon, resolve, compile."""

    def __init__(self, spark: SparkSession, system: Dictionary | None = None, description: str = "", built: int | None = None):
        if len(description.encode()) > MOST_DESCRIPTION:
            raise BuildError("description too long")
        self.spark, self.system, self.description, self.built = spark, system, description, built
        self.conn: DataFrame | None = None
        self.size = (0, 0)
        self.raw: DataFrame | None = None
        self.sources = 0
        self.parts: list[tuple[str, int, float]] = []
        self.definitions: dict[str, Any] = {}
        if system is not None:
            self.size, self.conn = (system.meta["lefts"], system.meta["rights"]), system.tables["conn"]

    def _timed(self, part: str, n: int, since: float) -> None:
        self.parts.append((part, n, time.time() - since))

    def read_conn(self, source: str | tuple[int, int, list[tuple[int, int, int]]]) -> DictionaryBuilder:
        """A matrix file, or (lefts, rights, entries)."""
        t = time.time()
        if isinstance(source, str):
            n, m, self.conn = read_matrix(self.spark, source)
        else:
            n, m, rows = source
            if any(not (0 <= a < n and 0 <= b < m) for a, b, _ in rows):
                raise BuildError("connection id out of range")
            self.conn = self.spark.createDataFrame(rows, "left int, right int, cost int").withColumn("cost", F.col("cost").cast("short"))
        self.size = (n, m)
        self._timed("matrix", n * m, t)
        return self

    def read_definitions(self, characters: str | list[str] | None = None, unknown: str | list[str] | None = None, rewrites: str | list[str] | None = None) -> DictionaryBuilder:
        """Definition files, or their lines: character classes with category rows, unknown words (after the matrix), rewrite rules. They are saved with the dictionary."""
        lines = lambda x: small_file(self.spark, x) if isinstance(x, str) else x
        t = time.time()
        if characters is not None:
            ranges, self.definitions["categories"] = parse_characters(lines(characters))
            if ranges:
                self.definitions["ranges"] = ranges
            self._timed("character classes", len(ranges), t)
        if unknown is not None:
            if self.conn is None:
                raise BuildError("no matrix")
            self.definitions["unknown"] = parse_unknown(lines(unknown), self.size[1], self.size[0])
            self._timed("unknown words", len(self.definitions["unknown"]), t)
        if rewrites is not None:
            self.definitions["rewrites"], self.definitions["exempt"] = parse_rewrites(lines(rewrites))
            self._timed("rewrite rules", len(self.definitions["rewrites"]), t)
        return self

    def set_compile_time(self, seconds: int) -> DictionaryBuilder:
        """The time, in seconds since 1970, that the dictionary gives for its building."""
        self.built = seconds
        return self

    def set_description(self, description: str) -> DictionaryBuilder:
        if len(description.encode()) > MOST_DESCRIPTION:
            raise BuildError("description too long")
        self.description = description
        return self

    def read_lexicon(self, source: str | list) -> DictionaryBuilder:
        """A lexicon file, or its lines or rows; several follow each other."""
        raw = read_lexicon(self.spark, source) if isinstance(source, str) else lexicon_rows(self.spark, source)
        raw = raw.select(F.struct(F.lit(self.sources).alias("s"), F.col("at.b").alias("b"), F.col("at.i").alias("i")).alias("at"), *LEXICON)
        self.raw = raw if self.raw is None else self.raw.unionByName(raw)
        self.sources += 1
        return self

    def compile(self) -> Dictionary:
        """Resolves references, checks everything and returns the dictionary; BuildError at the first row that can't be."""
        if self.conn is None:
            raise BuildError("no matrix")
        if self.raw is None:
            raise BuildError("no lexicon")
        t = time.time()
        lex = typed_lexicon(self.raw).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = lex.count()
            if n > MOST_WORDS:
                raise BuildError("too many words")
            sys_words = None if self.system is None else self.system.tables["lexicon"].where("dic_id = 0").count()
            first = lexicon_errors(lex, *self.size, n, sys_words).orderBy("line").first()
            if first:
                raise BuildError(first.error, first.line)
            self._timed("lexicon", n, t)
            t = time.time()
            known = None if self.system is None else self.system.tables["pos"]
            pos = intern_pos(lex, known)
            n_pos = pos.count()
            if n_pos > MOST_POS:
                raise BuildError("too many parts of speech")
            self._timed("parts of speech", n_pos, t)
            t = time.time()
            dic = 0 if self.system is None else 1
            own = lex.select((F.col("word_no").cast("long") + dic * OWN).alias("word_id"), "surface", "headword", *POS, "reading")
            system = None if self.system is None else self.system.tables["lexicon"].where("dic_id = 0").join(self.system.tables["pos"], "pos_id").select("word_id", "surface", "headword", *POS, "reading")
            out = lex.join(pos, POS)
            for c in ("split_a", "split_b", "structure"):
                got = resolve_units(lex, c, own, system, dic)
                if missing := got.where("missing").orderBy("word_no").first():
                    raise BuildError("split can't be resolved", missing.word_no + 1)
                out = out.drop(c).join(got.select("word_no", F.col("units").alias(c)), "word_no", "left").withColumn(c, F.coalesce(c, F.array().cast("array<long>")))
            ref = F.col("dictionary")
            form = F.when(ref.startswith("U"), F.substring(ref, 2, 12).cast("long") + dic * OWN).when(ref.isin("*", ""), None).otherwise(ref.cast("long"))
            head = F.when(F.col("headword") == "", F.col("surface")).otherwise(F.col("headword"))
            short = lambda c: F.when(F.col(c) == head, "").otherwise(F.col(c))
            table = out.select(
                F.lit(dic).alias("dic_id"), "word_no", (F.col("word_no").cast("long") + dic * OWN).alias("word_id"), "surface", F.octet_length("surface").alias("surface_bytes"), (F.col("left_id") >= 0).alias("indexed"), "left_id", "right_id", "cost",
                head.alias("headword"), "pos_id", short("reading").alias("reading"), short("normalized").alias("normalized"), form.alias("dic_form_word_id"), "unit", "split_a", "split_b", "structure", F.col("synonyms").cast("array<int>").alias("synonyms"),
            )
            rows = self.spark.createDataFrame(table.toArrow())  # a dictionary fits the driver, which broadcasts it anyway
            pos = self.spark.createDataFrame(pos.toArrow())
            self._timed("word infos", n, t)
        finally:
            lex.unpersist()
        meta = {"kind": "user" if dic else "system", "description": self.description, "built": int(time.time()) if self.built is None else self.built, "lefts": self.size[0], "rights": self.size[1], "words": n, "users": 0, "system_pos": n_pos if self.system is None else len(self.system.part_of_speech())}
        d = Dictionary({"lexicon": rows, "pos": pos, "conn": self.conn}, meta, **self.definitions)
        if d.unknown:  # their classes of words must exist
            for _, _, _, _, p in d.unknown:
                d.pos_id(p, "allow")
        if "categories" in self.definitions and "unknown" in self.definitions:
            d.config = Config(normalizers=({"class": "DefaultInputText"},), unknown=({"class": "MeCabOov"},))
        return d

    def report(self) -> DataFrame:
        """(part, size, seconds) of what was built."""
        return self.spark.createDataFrame(self.parts, "part string, size long, seconds double")


def build_system_dic(spark: SparkSession, matrix: str, lex: list[str], output: str, description: str = "", characters: str | None = None, unknown: str | None = None, rewrites: str | None = None) -> DataFrame:
    """Builds and saves a system dictionary from files; returns the report. With character and unknown-word definitions it analyses unknown words by itself, without a configuration."""
    b = DictionaryBuilder(spark, None, description).read_conn(matrix).read_definitions(characters, unknown, rewrites)
    for path in lex:
        b.read_lexicon(path)
    b.compile().save(output)
    return b.report()


def build_user_dic(spark: SparkSession, system: str, lex: list[str], output: str, description: str = "") -> DataFrame:
    """Builds and saves a user dictionary over a saved system dictionary; returns the report."""
    b = DictionaryBuilder(spark, Dictionary.load(spark, system, kind="system"), description)
    for path in lex:
        b.read_lexicon(path)
    b.compile().save(output)
    return b.report()


def char_ranges(spark: SparkSession, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """(lo, hi, mask) of the compiled classes, hi excluded."""
    return spark.createDataFrame(compile_ranges(ranges), "lo int, hi int, mask long")

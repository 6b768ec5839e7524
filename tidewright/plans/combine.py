"""Combining tables and comparing them: unions by several rules, record linkage, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.plans.fuzzy import similar
from tidewright.stored import dropped, stored


def combine(frames: list[DataFrame], columns: str = "all", fill: str | None = None) -> DataFrame:
    """One table of several: 'all' columns, 'common' ones (sorted), those of the 'first', or 'strict' (they must agree)."""
    if columns == "strict":
        names = {tuple(c.strip().lower() for c in f.columns) for f in frames}
        if len(names) > 1:
            raise ValueError("headers differ")
        out = reduce(DataFrame.union, frames)
        return out.filter(reduce(lambda a, b: a | b, [T.column(c).isNotNull() for c in out.columns]))
    if columns == "common":
        shared = sorted(set.intersection(*[set(f.columns) for f in frames]))
        if not shared:
            raise ValueError("no column in common")
        return reduce(DataFrame.union, [f.select(*map(T.column, shared)) for f in frames])
    if columns == "first":
        names = frames[0].columns
        return reduce(DataFrame.union, [f.select(*[T.column(c) if c in f.columns else F.lit(None).alias(c) for c in names]) for f in frames])
    if fill is None:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    # Only what a table doesn't have is filled, not its own nulls; such a column is text.
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    partly = {c for c in names if any(c not in f.columns for f in frames)}
    return reduce(DataFrame.unionByName, [f.select(*[(T.column(c).cast("string") if c in partly else T.column(c)).alias(c) if c in f.columns else F.lit(fill).alias(c) for c in names]) for f in frames])


def compatibility(frames: dict[str, DataFrame]) -> dict[str, list[str]]:
    every = sorted({c for f in frames.values() for c in f.columns})
    return {"all": every, "common": [c for c in every if all(c in f.columns for f in frames.values())]} | {f"missing in {n}": [c for c in every if c not in f.columns] for n, f in frames.items()}


def _both(keys: list):
    return reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])


def _norm(c: str) -> Column:
    return F.lower(T.squeezed(T.column(c)))


def _key(parts: list[Column]) -> Column:
    return F.when(_both(parts), F.concat_ws("\x1f", F.lit("="), *parts))


REASONS = {1: "Tier 1: Exact email match", 2: "Tier 2: Phone + Name match", 3: "Tier 3: Company + Location + Name match"}
FIELDS = ("email", "phone", "name", "city", "state", "company")


def _forms(email: str, phone: str, name: str, city: str, state: str, company: str) -> dict[str, Column]:
    """What is compared of a row, by field: text squeezed and in small letters, digits of the phone without a country's 1."""
    texts = {"email": email, "name": name, "city": city, "state": state, "company": company}
    return {f: _norm(c) for f, c in texts.items()} | {"phone": F.regexp_replace(T.digits(T.column(phone)), "^1([0-9]{10})$", "$1")}


def _formed(df: DataFrame, forms: dict[str, Column], shown: list, id: str, name: str) -> DataFrame:
    """shown and the forms as columns __email etc. (null where nothing is left), as a stored table: computed once, as an expression that
    joins and filters repeat is evaluated anew by each. Rows are dealt out before that, so that a small file's rows aren't one task's."""
    own = df.repartition(T.column(id)).select(*shown, *[c.alias(f"__{f}") for f, c in forms.items()])
    return stored(own.withColumns({f"__{f}": F.nullif(F.col(f"__{f}"), F.lit("")) for f in forms}), name)


def _first_exact(out: DataFrame, master: DataFrame, key: list[Column], i: int) -> DataFrame:
    """out with __m: the least m of the master's rows of its key."""
    found = master.select(_key(key).alias(f"__k{i}"), "__at").filter(_both(key)).groupBy(f"__k{i}").agg(F.min("__at").alias(f"__m{i}"))
    return out.join(found, f"__k{i}", "left")


def _first_similar(left: DataFrame, master: DataFrame, equal: list[Column], near: list[Column], least: list[int], i: int) -> DataFrame:
    """__k, __m, __s: of each key of left the least master row whose near columns reach the ratios, one after the other, and the ratios."""
    held = master.filter(_both(equal + near)).select(_key(equal).alias("block"), *[c.alias(f"a{j}") for j, c in enumerate(near)], F.col("__at").alias("m"))
    held = stored(held.groupBy("block", *[f"a{j}" for j in range(len(near))]).agg(F.min("m").alias("m")), "link-held")
    asked = stored(left.filter(_both(equal + near)).select(_key(equal).alias("block"), *[c.alias(f"b{j}") for j, c in enumerate(near)], F.col(f"__k{i}").alias("k")).distinct(), "link-asked")
    found, tables = None, [held, asked]
    mine, theirs = asked, held
    for j, percent in enumerate(least):
        pairs = similar(theirs.select("block", F.col(f"a{j}").alias("value")), mine.select("block", F.col(f"b{j}").alias("value")), percent)
        tables.append(pairs)
        # What is similar so far is the next one's block: both rows stand under the pair that they met by.
        step = F.concat_ws("\x1f", "block", "a", "b")
        theirs = theirs.join(pairs.select("block", F.col("a").alias(f"a{j}"), "b", F.col("ratio").alias(f"s{j}")).hint("merge"), ["block", f"a{j}"]).withColumn("a", F.col(f"a{j}")).withColumn("block", step).drop("a", "b")
        mine = mine.join(pairs.select("block", "a", F.col("b").alias(f"b{j}")).hint("merge"), ["block", f"b{j}"]).withColumn("b", F.col(f"b{j}")).withColumn("block", step).drop("a", "b").distinct()
    ratios = F.array(*[F.col(f"s{j}") for j in range(len(least))])
    found = stored(mine.select("block", "k").join(theirs.select("block", "m", ratios.alias("s")).hint("merge"), "block").groupBy("k").agg(F.min(F.struct("m", "s")).alias("x")).select(F.col("k").alias(f"__k{i}"), F.col("x.m").alias(f"__m{i}"), F.col("x.s").alias(f"__s{i}")), "link-similar")
    dropped(*tables)
    return found


def link(master: DataFrame, other: DataFrame, master_id: str, other_id: str, email: str, phone: str, name: str, city: str, state: str, company: str, mode: str = "exact", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each row of other with its first match in master by three tiers: e-mail; phone and name; company, city, state and name.

    mode 'exact': all are equal. 'fuzzy': names of ratio 85 on equal phones; companies of 85 and names of 75 on equal
    city and state. fields: those that count; the second tier needs phone and name, the third company, city or state (and is then compared whole).
    Added are Overlap_Tier, Matched_With_Index and Match_Reason, in fuzzy mode with the ratios.

    Exact tiers are equi-joins on the least id of a key, so no key fans out. Fuzzy ones find the pairs of values of a block by an index of
    their pieces (plans/fuzzy.py), and join back to rows by key. Blank keys stay out.
    """
    if mode not in ("exact", "fuzzy"):
        raise ValueError("mode has to be exact or fuzzy")
    forms = _forms(email, phone, name, city, state, company)
    own = {f: F.col(f"__{f}") for f in forms}
    tiers = {0: [own["email"]]}
    near: dict[int, tuple[list[Column], list[Column], list[int]]] = {}
    if {"phone", "name"} <= set(fields):
        tiers[1] = [own["phone"], own["name"]]
        near[1] = ([own["phone"]], [own["name"]], [85])
    if {"company", "city", "state"} & set(fields):
        tiers[2] = [own[f] for f in ("company", "city", "state", "name")]
        near[2] = ([own["city"], own["state"]], [own["company"], own["name"]], [85, 75])
    # Rows without a key are dealt by their ids, so that they don't meet in one task; no key of master begins like that.
    none = F.concat(F.lit("!"), F.coalesce(F.xxhash64(T.column(other_id)).cast("string"), F.lit("")))
    forms = {f: c for f, c in forms.items() if any(own[f] is k for key in tiers.values() for k in key)}
    held = _formed(master, forms, [T.column(master_id).alias("__at")], master_id, "link-master")
    out = _formed(other, forms, ["*"], other_id, "link-other").withColumns({f"__k{i}": F.coalesce(_key(k), none) for i, k in tiers.items()})
    done = []
    for i, k in tiers.items():
        if mode == "fuzzy" and i in near:
            left = out.filter(reduce(lambda a, b: a & b, [F.col(f"__m{j}").isNull() for j in done]))
            out = out.join(_first_similar(left, held, *near[i], i), f"__k{i}", "left")
        else:
            out = _first_exact(out, held, k, i)
        done.append(i)
    tier = F.coalesce(*[F.when(F.col(f"__m{i}").isNotNull(), i + 1) for i in done])
    labels = {1: ["Name_Similarity"], 2: ["Company_Similarity", "Name_Similarity"]}
    reason = F.lit(None).cast("string")
    for i in reversed(done):
        said = F.lit(REASONS[i + 1])
        if mode == "fuzzy" and i in near:
            scores = [F.concat(F.lit(f"{label}="), F.get(F.col(f"__s{i}"), j).cast("string"), F.lit("%")) for j, label in enumerate(labels[i])]
            said = F.concat(said, F.lit(" ("), F.concat_ws(", ", *scores), F.lit(")"))
        reason = F.when(F.col(f"__m{i}").isNotNull(), said).otherwise(reason)
    added = {"Overlap_Tier": tier, "Matched_With_Index": F.coalesce(*[F.col(f"__m{i}") for i in done]), "Match_Reason": reason}
    return out.withColumns(added).drop(*[f"__{x}{i}" for i in done for x in "kms"], *[f"__{f}" for f in forms])


FILE_REASONS = {1: "Email Match", 2: "Phone + Name Match", 3: "Company + Location Match"}


def _patterns() -> list[tuple[str, ...]]:
    """What a row of the third tier may have beside its name: company, city and state, one of them at least."""
    places = ("company", "city", "state")
    return [tuple(p for i, p in enumerate(places) if bits >> i & 1) for bits in range(1, 8)]


def _first_in_master(other: DataFrame, held: DataFrame, id: str) -> DataFrame:
    """other with Overlap_Tier and __at of its first match in held by the tiers of several files; both have the forms of _formed.

    The third tier compares name and whatever of company, city and state the row itself has. So a row has one key, which begins with the
    names of these fields, and a row of held one for each set of fields that it could be asked by.
    """
    own = {f: F.col(f"__{f}") for f in FIELDS}
    places = lambda p: _key([F.lit(",".join(p)), *[own[f] for f in p], own["name"]])
    has = lambda p: reduce(lambda a, b: a & b, [own[f].isNotNull() if f in p else own[f].isNull() for f in ("company", "city", "state")])
    asked = {"__k0": _key([own["email"]]), "__k1": _key([own["phone"], own["name"]]), "__k2": F.coalesce(*[F.when(has(p), places(p)) for p in _patterns()])}
    keys = {"__k0": asked["__k0"], "__k1": asked["__k1"], "__k2": F.explode(F.array_compact(F.array(*map(places, _patterns()))))}
    none = F.concat(F.lit("!"), F.coalesce(F.xxhash64(T.column(id)).cast("string"), F.lit("")))
    out = other.withColumns({k: F.coalesce(v, none) for k, v in asked.items()})
    for k, v in keys.items():
        found = held.select(v.alias(k), F.col("__at").alias("m")).filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("m").alias(f"{k}_m"))
        out = out.join(found, k, "left")
    first = [F.col(f"{k}_m") for k in keys]
    tier = F.coalesce(*[F.when(c.isNotNull(), i) for i, c in enumerate(first, 1)])
    return out.withColumns({"Overlap_Tier": tier, "__at": F.coalesce(*first)}).drop(*keys, *[f"{k}_m" for k in keys])


def link_files(files: dict[str, DataFrame], id: str, email: str, phone: str, name: str, city: str, state: str, company: str) -> DataFrame:
    """Rows of all files with their first match in what came before: equal e-mail; equal phone and name; equal name and equal company,
    city and state as far as the row has them (one of the three at least).

    The first file is the master, which grows by each file's rows without a match, so a file is not compared with
    itself. Columns Source_File, Overlap_Tier, Match_Reason, Matched_File and Matched_With_Index are added; columns of
    a file that others lack are null there. Each file's matches are stored, so plans don't double with files.
    """
    (first, master), *others = files.items()
    forms = _forms(email, phone, name, city, state, company)
    names, kept = list(files), ["__at", *[f"__{f}" for f in forms]]
    at_of = lambda i: F.struct(F.lit(i).alias("file"), T.column(id).alias("id")).alias("__at")
    held = _formed(master, forms, [at_of(0)], id, "link-master")
    done = [master.select(F.lit(first).alias("Source_File"), "*", F.lit(None).cast("int").alias("Overlap_Tier"), F.lit(None).cast("string").alias("Match_Reason"), F.lit(None).cast("string").alias("Matched_File"), F.lit(None).cast(master.schema[id].dataType).alias("Matched_With_Index"))]
    for i, (source, df) in enumerate(others, 1):
        asked = _formed(df, forms, ["*"], id, "link-asked")
        found = stored(_first_in_master(asked, held, id), "link-file")
        dropped(asked)
        at = F.col("__at")
        done.append(found.select(F.lit(source).alias("Source_File"), *map(T.column, df.columns), "Overlap_Tier", T.lookup(F.col("Overlap_Tier"), FILE_REASONS).alias("Match_Reason"), F.get(F.array(*map(F.lit, names)), at["file"]).alias("Matched_File"), at["id"].alias("Matched_With_Index")))
        held = held.unionByName(found.filter("Overlap_Tier is null").withColumn("__at", at_of(i)).select(*kept))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)


def link_summary(linked: DataFrame) -> DataFrame:
    """Of each file and of all (Source_File null): rows, matches by tier, rows without a match, and percent of matches.

    linked is what link_files returns.
    """
    tier = F.col("Overlap_Tier")
    counts = [F.count("*").alias("records"), *[F.count_if(tier == k).alias(f"tier{k}_matches") for k in FILE_REASONS], F.count_if(tier.isNull()).alias("unique_records")]
    return linked.rollup("Source_File").agg(*counts, F.round(F.count(tier) * 100 / F.count("*"), 2).alias("overlap_rate"))


def with_source(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of named tables under their names in Source_File, which comes first; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(F.lit(n).alias("Source_File"), *[T.column(c) for c in f.columns if c != "Source_File"]) for n, f in frames.items()])


def groupable(df: DataFrame, most: int = 100) -> DataFrame:
    """Columns by which a table may be split: at most so many distinct values, and fewer than half of its rows."""
    aggs = [F.count("*").alias("rows"), *[F.count_distinct(T.column(c)).alias(f"d{i}") for i, c in enumerate(df.columns)]]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values"), F.col("rows")) for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.inline(parts)).filter((F.col("distinct_values") <= most) & (F.col("distinct_values") * 2 < F.col("rows"))).drop("rows")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def profile(df: DataFrame) -> DataFrame:
    """Rows, and of each column its nulls, blanks and distinct values (about), in one pass."""
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        own = T.column(c)
        aggs += [F.count_if(own.isNull()).alias(f"n{i}"), F.count_if(T.blank(own)).alias(f"b{i}"), F.approx_count_distinct(own).alias(f"d{i}")]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("blanks"), F.col(f"d{i}").alias("distinct_about")) for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.inline(parts))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows share their key with another."""
    counts = df.groupBy(*map(T.column, keys)).count()
    return counts.agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"))

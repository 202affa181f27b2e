"""Facts out of card texts whose pairs run into each other.

A text is cut into chunks, and a chunk is read from its beginning: a key, the
place in its value where another pair begins, the key there, and so on. Where a
pair may begin is told by punctuation, or by a key of the dictionary inside the
value; these places do not depend on each other, so they are found for all words
of a chunk at once, and a fold over them steps from pair to pair. For the keys
the words of each card meet the first words of all synonyms in one equi-join; a
card then carries the few synonyms its texts hold, and keys are looked up there,
without another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.display import plain_parts, without_legal_tail
from kartoteka.functions.text import fold, html_chunks, is_heading_line, let, norm_key, squeeze, strip_html

#: An explicit separator between a key and its value.
SEPARATOR = "\\s+[-–—]\\s+|\\s*:\\s+"
#: Answers that stand alone.
ANSWERS = "да|нет|есть|имеется"
#: What the keys of packed lists speak of.
LISTED = "габарит|размер|двер|вес|масс|объ[её]м|нетто|брутто|перевеш|перенавеш|шум|класс"
#: A phrase of several words without a pair, and the pair after it.
ORPHAN = "(?su)^([^:–—]{2,80}?)\\.\\s+(\\p{L}[^:\\n]{1,80}:\\s*\\S.*)$"
#: A value that ends in a small letter or a bracket runs into the next one.
CASE = "(?s)^(.+?[\\p{Ll})])\\s*(?=[\\p{Lu}\\d])"
#: Shortest and longest value before a cut, longest before a listed key, and longest keys: after a full stop, elsewhere.
SHORTEST, LONGEST, LONGEST_SHORT, LONGEST_STOPPED, LONGEST_KEY = 2, 160, 40, 80, 70
#: Words of punctuation and units that a key may have beside its own.
BESIDE = 8

PAIRS = "array<struct<key:string,value:string,via:string,code:string>>"


def _bare_value(t: Column) -> Column:
    return ~t.rlike(SEPARATOR) & (t.rlike(f"(?iu)^(?:{ANSWERS})$") | t.rlike("(?iu)^[A-GА-Е]\\+{0,3}$") | t.rlike("^-?\\d"))


def _key_only(t: Column) -> Column:
    return ~t.rlike(SEPARATOR) & ~_bare_value(t) & ~is_heading_line(t) & t.rlike("\\p{L}") & ~t.rlike("^\\d") & (F.length(t) <= 80)


def stitched_lines(chunks: Column) -> Column:
    """Lines with a key alone joined with the bare value on the next line ("key: value").

    A line cannot be both, so each pair is seen from either end without replay.
    """
    seen = F.transform(chunks, lambda t: F.struct(t.alias("t"), _key_only(t).alias("k"), _bare_value(t).alias("v")))
    at = lambda x, i, f: F.coalesce(F.get(x, i)[f], F.lit(False))
    joined = lambda s: F.transform(s, lambda x, i: F.when(x["v"] & (i > 0) & at(s, i - 1, "k"), None).when(x["k"] & at(s, i + 1, "v"), F.concat_ws(": ", x["t"], F.get(s, i + 1)["t"])).otherwise(x["t"]))
    return F.array_compact(let(seen, joined))


def known_keys(cards: DataFrame, texts: list[str], synonyms: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """cards (id, texts ...) with `known`: a map from the synonyms whose words stand in the texts, in normal form, to their codes; and `barred`, the blacklisted phrases among them.

    ids are one a card. Synonyms (synonym, code, order) and phrases are looked up
    by their first word, so a card meets those alone that begin with a word of
    its own; the least order wins among equal synonyms.
    """
    entries = synonyms.select(norm_key(F.col("synonym")).alias("normal"), "code", "order").groupBy("normal").agg(F.min_by("code", F.struct("order", "code")).alias("code"))
    if blacklist is not None:
        entries = entries.unionByName(blacklist.select(norm_key(F.col("phrase")).alias("normal"), F.lit(None).cast("string").alias("code")).distinct())
    entries = entries.filter("normal <> ''").withColumn("word", F.substring_index("normal", " ", 1))
    said = cards.select("id", norm_key(strip_html(F.concat_ws(" . ", *texts))).alias("said"))
    words = said.select("id", "said", _each(F.array_distinct(F.split("said", " "))).alias("word"))
    stands = F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "normal", F.lit(" ")))
    met = words.join(entries, "word").filter(stands).groupBy("id").agg(F.collect_set(F.when(F.col("code").isNotNull(), F.struct("normal", "code"))).alias("known"), F.collect_set(F.when(F.col("code").isNull(), F.col("normal"))).alias("barred"))
    held = cards.join(met, "id", "left")
    known = F.coalesce(F.map_from_entries("known"), F.create_map().cast("map<string,string>"))
    return held.withColumn("known", known).withColumn("barred", F.coalesce("barred", F.array().cast("array<string>")))


def _each(array: Column) -> Column:
    """Its elements as rows, an empty array as a null: else the optimizer would compute the array once more, for a filter on its size."""
    return F.explode_outer(array)


def _placed(array: Column) -> Column:
    return F.posexplode_outer(array)


def _code(known: Column, key: Column) -> Column:
    return F.try_element_at(known, norm_key(key))


def _pair(key: Column, value: Column, via: str, code: Column) -> Column:
    there = (F.coalesce(key, F.lit("")) != "") & (F.coalesce(value, F.lit("")) != "")
    return F.when(there, F.struct(key.alias("key"), value.alias("value"), F.lit(via).alias("via"), code.cast("string").alias("code")))


def split_known_prefix(text: Column, normal: Column) -> Column:
    """struct<key, value>: text cut after the most words whose normal form is `normal`, spelled as they are; null where none has it or no value is left."""
    words = F.split(text, "\\s+")
    most = F.least(F.size(words) - 1, F.size(F.split(normal, " ")) + BESIDE)
    fits = F.filter(F.when(most >= 1, F.sequence(F.lit(1), most)), lambda n: norm_key(F.array_join(F.slice(words, F.lit(1), n), " ")) == normal)
    cut = lambda n: F.struct(F.array_join(F.slice(words, F.lit(1), n), " ").alias("key"), F.regexp_replace(F.regexp_replace(F.array_join(F.slice(words, n + 1, F.size(words)), " "), "^[:\\-–—]\\s*", ""), "\\s*[.;]\\s*$", "").alias("value"))
    return let(F.array_max(fits), lambda n: F.when(n.isNotNull(), let(cut(n), lambda c: F.when(c["value"] != "", c))))


def _known_start(text: Column, known: Column, barred: Column) -> Column:
    """The pair of a text that begins with a synonym, the longest; a synonym counts not where a barred phrase goes on with the text's next word."""

    def longest(normal: Column) -> Column:
        next_word = lambda k: F.substring_index(F.substr(normal, F.length(k) + 2), " ", 1)
        free = lambda k: ~F.exists(barred, lambda b: F.startswith(b, F.concat_ws(" ", k, next_word(k))))
        fits = F.filter(F.map_keys(known), lambda k: (normal == k) | (F.startswith(normal, F.concat(k, F.lit(" "))) & free(k)))
        return F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]

    found = let(norm_key(text), longest)
    return let(found, lambda k: F.when(k.isNotNull(), let(split_known_prefix(text, k), lambda c: _pair(c["key"], c["value"], "dict", F.try_element_at(known, k)))))


def first_pair(text: Column, known: Column, barred: Column) -> Column:
    """struct<key, value, via, code> a text begins with, or null.

    An explicit separator counts (sep) unless its key is unknown and the text
    begins with a known one (dict), or a digit begins it; without a separator a
    known beginning counts before a change from small letter to capital or digit
    (case). Headings hold none.
    """

    def read(t: Column) -> Column:
        parts = F.split(t, SEPARATOR, 2)
        key = squeeze(F.get(parts, F.lit(0)))
        sep = F.when((F.size(parts) == 2) & ~key.rlike("^\\d"), _pair(key, squeeze(F.get(parts, F.lit(1))), "sep", _code(known, key)))
        head = squeeze(F.regexp_extract(t, CASE, 1))
        case = F.when(F.length(head) >= 3, _pair(head, squeeze(F.regexp_replace(t, CASE, "")), "case", F.lit(None)))
        start = _known_start(t, known, barred)
        chosen = lambda s: F.when(s["code"].isNotNull(), s).otherwise(F.coalesce(start, s, case))
        return F.when(~is_heading_line(t), let(sep, chosen))

    return let(squeeze(F.regexp_replace(squeeze(text), "[.;]\\s*$", "")), read)


def with_places(chunks: DataFrame) -> DataFrame:
    """chunks (text, known ...) with `words` and what stands where among them, numbered from 0.

    begin: the character each word begins at. ends: words a key may end with, as
    a colon ends them or a dash follows. stops: words after a full stop that
    begin a key before a colon. listed: words that begin a key of a listed kind.
    answers: bare answers before a key. keys: words that may begin a synonym, with
    its code where a separator follows it.
    """
    w, n = F.col("words"), F.size("words")
    at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    among = lambda holds: F.filter(F.when(n > 1, F.sequence(F.lit(0), n - 1)), holds)
    begin = lambda i: F.get("begin", i)
    after = lambda places, i: F.get(F.filter(F.col(places), lambda p: p > i), F.lit(0))
    rows = chunks.withColumn("words", F.split(squeeze("text"), " "))
    rows = rows.withColumn("begin", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.length(F.array_join(F.slice(w, F.lit(1), i), " ")) + (i > 0).cast("int")))
    rows = rows.withColumns({"dashes": among(lambda i: at(i).rlike("^[-–—]$") & (i > 0) & (i < n - 1)), "signs": among(lambda i: at(i).rlike("^[-–—:]") & (i > 0)), "colons": among(lambda i: at(i).rlike(":.|[–—]") | (at(i).rlike(":$") & (i < n - 1)))})
    rows = rows.withColumn("ends", among(lambda i: (at(i).rlike(":$") & (i < n - 1)) | (F.array_contains("dashes", i + 1) & ~at(i).rlike("^[-–—]$"))))
    # how far it is from a word's second letter to the next colon, dash or sign; words of a key hold none of the others
    gap = lambda places, i: begin(after(places, i)) - begin(i) - 2
    colon = lambda i: F.get(F.filter("colons", lambda c: (c >= i) & F.contains(at(c), F.lit(":"))), F.lit(0))
    to_colon = lambda i: begin(colon(i)) + F.instr(at(colon(i)), ":") - begin(i) - 2
    clean = lambda places, i: F.coalesce(after(places, i) <= F.get(F.filter("colons", lambda c: (c >= i)), F.lit(0)), F.lit(True))
    keyed = lambda places, i: gap(places, i).between(2, LONGEST_KEY) & clean(places, i)
    rows = rows.withColumns(
        {
            "stops": among(lambda i: (i > 0) & at(i - 1).rlike("\\.$") & at(i).rlike("^\\p{L}") & to_colon(i).between(1, LONGEST_STOPPED)),
            "listed": among(lambda i: (i > 0) & at(i).rlike("^\\p{Lu}") & keyed("dashes", i)),
            "answers": among(lambda i: at(i).rlike(f"(?iu)^(?:{ANSWERS})$") & at(i + 1).rlike("^\\p{L}") & keyed("signs", i + 1)),
        }
    )
    rows = rows.withColumn("listed", F.filter("listed", lambda i: F.array_join(F.slice(w, i + 1, n), " ").rlike(f"(?iu){LISTED}")))
    firsts = F.array_distinct(F.transform(F.map_keys("known"), lambda k: F.substring_index(k, " ", 1)))
    longest = F.coalesce(F.array_max(F.transform(F.map_keys("known"), lambda k: F.size(F.split(k, " ")))), F.lit(0)) + BESIDE
    rows = rows.withColumns({"firsts": firsts, "longest": longest})
    # a word as norm_key() has it, but for units and brackets: punctuation as spaces, quotes gone
    plain = lambda x: F.substring_index(F.trim(F.translate(fold(x), "()[],.;:!?*/\\|+-–—×х«»„“”\"'`", " " * 18 + "xx")), " ", 1)
    rows = rows.withColumn("heads", among(lambda i: F.array_contains("firsts", plain(at(i)))))
    spelled = lambda i, many: F.regexp_replace(F.array_join(F.slice(w, i + 1, many), " "), "\\s*:$", "")
    end = lambda i: F.get(F.filter("ends", lambda e: e >= i), F.lit(0))
    code = lambda i: F.when(end(i) - i < F.col("longest"), F.try_element_at("known", norm_key(spelled(i, end(i) - i + 1))))
    return rows.withColumn("keys", F.transform("heads", lambda i: F.struct(i.alias("at"), code(i).alias("code"))))


def with_segments(chunks: DataFrame) -> DataFrame:
    """chunks (text, known ...) with `segments`: the text cut where pairs begin. What with_places() adds is dropped again."""
    own = chunks.columns
    rows = with_places(chunks)
    first = lambda places, holds: F.array_min(F.filter(F.col(places), holds))
    begin = lambda i: F.get("begin", i)
    # where the value of a pair that begins at b begins: after the separator, unless a synonym begins there whose own separator it is not
    end = lambda b: first("ends", lambda e: e >= b)
    after_end = lambda e: F.when(F.array_contains("dashes", e + 1), e + 2).otherwise(e + 1)
    key = lambda b: F.get(F.filter("keys", lambda k: k["at"] == b), F.lit(0))
    orphan = lambda b, e: F.exists("stops", lambda j: (j > b + 1) & (j <= e) & (begin(j) - begin(b) <= LONGEST_STOPPED + 2))
    size = lambda v, j: begin(j) - begin(v) - 1
    fits = lambda v, j, most=LONGEST: size(v, j).between(SHORTEST, most)

    def following(v: Column) -> Column:
        ways = [
            first("stops", lambda j: (j > v) & fits(v, j, LONGEST + 1) & (size(v, j) > SHORTEST)),  # the stop is no part of the value
            F.when(F.array_contains("answers", v), v + 1),
            first("listed", lambda j: (j > v) & size(v, j).between(1, LONGEST_SHORT)),
            first("known_at", lambda j: (j > v) & fits(v, j)),
        ]
        return F.least(*ways)

    places = F.array_distinct(F.concat(F.array(F.lit(0)), "stops", F.transform("answers", lambda i: i + 1), "listed", "known_at"))
    rows = rows.withColumn("known_at", F.transform(F.filter("keys", lambda k: k["code"].isNotNull()), lambda k: k["at"]))
    rows = rows.withColumn("places", F.coalesce(places, F.array(F.lit(0))))
    rows = rows.withColumn("ended", F.transform("places", lambda b: F.struct(b.alias("b"), end(b).alias("e"), key(b).alias("k"))))
    synonym = lambda b: F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.col("longest"), F.size("words") - b)), lambda m: F.try_element_at("known", norm_key(F.array_join(F.slice("words", b + 1, m), " "))).isNotNull()))
    early = F.transform("ended", lambda x: F.when(x["k"].isNotNull() & x["k"]["code"].isNull() & ~orphan(x["b"], x["e"]), x["b"] + synonym(x["b"])))
    rows = rows.withColumn("early", early).withColumn("valued", F.zip_with("early", "ended", lambda v, x: F.coalesce(v, after_end(x["e"]))))
    rows = rows.withColumn("next", F.transform("valued", following))
    step = lambda s, _: F.concat(s, F.array(F.get("next", F.array_position("places", F.element_at(s, -1)).cast("int") - 1)))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("places")), F.array(F.lit(0)), step)
    rows = rows.withColumn("at", F.array_compact(walk))
    piece = lambda b, i: F.array_join(F.slice("words", b + 1, F.coalesce(F.get("at", i + 1), F.size("words")) - b), " ")
    return rows.withColumn("segments", F.transform("at", piece)).select(*own, "segments")


def without_orphans(text: Column) -> Column:
    """A text without the phrases of several words, up to five, that stand before its first pair and hold none."""
    step = lambda t, _: let(F.regexp_extract(t, ORPHAN, 1), lambda lead: F.when((lead != "") & ~lead.rlike(SEPARATOR) & squeeze(lead).rlike("\\s"), squeeze(F.regexp_extract(t, ORPHAN, 2))).otherwise(t))
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), squeeze(text), step)


def segment_pairs(segments: DataFrame) -> DataFrame:
    """segments (text, last, known, barred ...) with key, value, via, code: the pair of each; segments without one go.

    A value that holds a pair itself gives that one where the outer key is a
    heading: before a cut always, at the end of a chunk only where the inner key
    is known, or the outer one is not and the inner value is shorter.
    """
    known, barred = F.col("known"), F.col("barred")
    rows = segments.withColumn("outer", first_pair(without_orphans(F.col("text")), known, barred))
    rows = rows.withColumn("inner", F.when(F.col("outer.value").rlike(SEPARATOR), first_pair(F.col("outer.value"), known, barred)))
    shorter = (F.col("inner.via") == "sep") & (F.length("inner.value") < F.length("outer.value")) & F.col("outer.code").isNull()
    inner = F.when(F.col("last"), F.col("inner.code").isNotNull() | shorter).otherwise(F.col("inner.code").isNotNull() | (F.col("inner.via") != "case"))
    pair = F.when((F.col("inner.key") != F.col("outer.key")) & inner, F.col("inner")).otherwise(F.col("outer"))
    return rows.select(*segments.columns, _each(F.array(pair)).alias("p")).filter("p is not null").select(*segments.columns, "p.*")


def text_pairs(cards: DataFrame, texts: dict[str, str], synonyms: DataFrame, blacklist: DataFrame | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, *keep, source, seq, key, value, via, code): the pairs of cards' texts (a column and the source it is), in order.

    Of a text its list items or lines are read, then what stands outside lists.
    A text of one chunk without a cut is read as a paragraph: its sentences, or
    what stands between semicolons or wide spaces, if there are three. Legal
    phrases after a value are cut off. Ids are one a card; cards whose texts are
    all equal are read once. keep: columns made of the texts, by name.
    """
    keep = keep or {}
    said = F.concat(*[F.coalesce(F.sha2(F.col(c), 256), F.lit("-")) for c in texts])
    marked = cards.select("id", said.alias("said_as"), *texts)
    # reading a text costs far more than moving it: different ones are dealt out to as many tasks as a shuffle has, however few bytes they are, and the join on id needs no other exchange
    different = marked.select(F.col("said_as").alias("id"), *texts).distinct().repartition(int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    pairs = _read_pairs(different.withColumns(keep) if keep else different, texts, synonyms, blacklist, tuple(keep))
    return marked.select("id", "said_as").join(pairs.withColumnRenamed("id", "said_as"), "said_as").drop("said_as")


def _read_pairs(cards: DataFrame, texts: dict[str, str], synonyms: DataFrame, blacklist: DataFrame | None, keep: tuple[str, ...]) -> DataFrame:
    """text_pairs() of cards that lie as they are to be read."""
    outside = lambda t: F.regexp_replace(F.regexp_replace(t, "(?is)<(ul|ol)(?:\\s[^>]*)?>.*?</\\1>", " "), "(?is)<li(?:\\s[^>]*)?>.*?</li>", " ")
    told = known_keys(cards, list(texts), synonyms, blacklist)
    each = told.select("id", *keep, "known", "barred", _each(F.array(*[F.struct(F.lit(source).alias("source"), F.coalesce(F.col(c), F.lit("")).alias("html")) for c, source in texts.items()])).alias("t")).select("*", "t.*").drop("t")
    each = each.filter("html <> ''").withColumn("rest", F.when(F.col("html").rlike("(?i)<li[\\s>/]"), outside(F.col("html"))))
    parts = F.when(F.length(strip_html(F.col("rest"))) > 20, F.array("html", "rest")).otherwise(F.array("html"))
    each = each.select("*", _placed(parts).alias("part", "text")).drop("html", "rest")
    lines = each.withColumn("lines", stitched_lines(html_chunks(F.col("text"))))
    lines = lines.withColumn("phrases", F.when(F.size("lines") <= 1, plain_parts(F.regexp_replace("text", "<[^>]+>", " "))))
    lines = lines.withColumn("lines", F.when((F.size("lines") == 0) & F.col("phrases").isNotNull(), F.array(F.lit(""))).otherwise(F.col("lines"))).drop("text")
    first = with_segments(lines.select("*", _placed(F.col("lines")).alias("line", "text")).drop("lines"))
    again = F.col("phrases").isNotNull() & (F.size("segments") <= 1)
    as_said = F.struct("segments", F.lit(None).cast("string").alias("text"))
    read = F.when(again, F.transform("phrases", lambda p: F.struct(F.lit(None).cast("array<string>").alias("segments"), p.alias("text")))).otherwise(F.array(as_said))
    second = first.select("id", *keep, "known", "barred", "source", "part", "line", _placed(read).alias("phrase", "r")).select("*", F.col("r.segments").alias("done"), F.col("r.text").alias("text")).drop("r")
    cut = with_segments(second).withColumn("segments", F.coalesce("done", "segments")).drop("done", "text")
    pieces = cut.select("*", F.size("segments").alias("n"), _placed(F.col("segments")).alias("step", "text")).withColumn("last", F.col("step") == F.col("n") - 1)
    seq = F.struct("part", "line", "phrase", "step")
    pairs = segment_pairs(pieces).withColumn("value", without_legal_tail(F.col("value"))).filter("value <> ''")
    return pairs.select("id", *keep, "source", seq.alias("seq"), "key", "value", "via", "code")

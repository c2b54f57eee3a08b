"""Arrays of tokens, lengths and turns: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

IGNORED = -100
# The ids that open and close an assistant turn.
OPEN_ID, CLOSE_ID = 77091, 151645
BASE_TOKENS, IMAGE_TOKENS = 21, 128


def label_mask(ids: Column, open_id: int = OPEN_ID, close_id: int = CLOSE_ID) -> Column:
    """G-15: the ids of the answers, everything else ignored.

    An answer begins two after an opening id and ends with the first closing id from there and one id more. An
    opening id inside an answer opens nothing; one without a close labels nothing.
    """
    n = F.size(ids)

    def masked(spans):
        return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (s.a <= i) & (i <= s.b)), x).otherwise(F.lit(IGNORED).cast("long")))

    places = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    closes = F.filter(places, lambda i: F.get(ids, i) == close_id)
    opens = F.filter(places, lambda i: F.get(ids, i) == open_id)

    def step(acc, o, closes):
        close = F.array_min(F.filter(closes, lambda c: c >= o + 2))
        found = (o >= acc.free) & close.isNotNull()
        return F.when(found, F.struct(F.concat(acc.spans, F.array(F.struct((o + 2).alias("a"), (close + 1).alias("b")))).alias("spans"), close.alias("free"))).otherwise(acc)

    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(0).alias("free"))
    bind = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  the value once, not for each element
    return bind(closes, lambda c: bind(F.aggregate(opens, start, lambda acc, o: step(acc, o, c), lambda acc: acc.spans), masked))


def pad(values: Column, size: Column, fill) -> Column:
    """G-16: cut or filled up to a length."""
    fill = F.lit(fill).cast("long")
    return F.slice(F.concat(values.cast("array<long>"), F.array_repeat(fill, F.greatest(size - F.size(values), F.lit(0)))), F.lit(1), size)


def cumulative_lengths(lengths: Column, block: int = 256) -> Column:
    """W-05: [0, l1, l1 + l2, ...]. A fold that appends copies what it has, so it runs over blocks and inside each block."""

    def fold(items, at):
        start = F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, n: F.struct((acc.at + n).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
        return F.aggregate(items, start, step, lambda acc: acc.out)

    zero = F.lit(0).cast("long")
    longs = F.concat(lengths.cast("array<bigint>"), F.array(zero))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")), lambda k: F.slice(longs, k * block + 1, F.lit(block)))
    sums = F.transform(cut, lambda b: F.aggregate(b, zero, lambda acc, n: acc + n))
    return F.flatten(F.transform(F.arrays_zip(cut.alias("b"), fold(sums, zero).alias("at")), lambda x: fold(x["b"], x["at"])))


def word_length(values: Column, has_image: Column) -> Column:
    """A-23: words of all turns, and as many again for an image as one counts."""
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + F.size(words(v))) + F.when(has_image, IMAGE_TOKENS).otherwise(0)


def signed_length(length: Column, has_media: Column) -> Column:
    """A-24."""
    return F.when(has_media, length).otherwise(-length)


def token_total(values: Column, media_tokens: Column, count: Callable[[Column], Column] | None = None) -> Column:
    """A-26: a base, the tokens of each turn, and those of the media. ``count`` is the tokenizer: a text's tokens as a Column; words if none is given.
    One that needs Python is a pandas UDF over the exploded turns, whose sums come here as media tokens do."""
    count = count or (lambda v: F.size(words(v)))
    return F.lit(BASE_TOKENS) + F.aggregate(values, F.lit(0), lambda acc, v: acc + F.coalesce(count(v), F.lit(0)).cast("int")) + F.coalesce(media_tokens, F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """S-04: of two id lists as sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def ordered_union(a: Column, b: Column) -> Column:
    """S-05."""
    return F.array_distinct(F.concat(a, b))


def padded_translations(zh: Column, phrases: Column) -> Column:
    """G-22: as many translations as phrases, empty where there is none."""
    zh = F.coalesce(zh, F.array().cast("array<string>"))
    return F.slice(F.concat(zh, F.array_repeat(F.lit(""), F.greatest(F.size(phrases) - F.size(zh), F.lit(0)))), F.lit(1), F.size(phrases))


def chunk_of(position: Column, mean_length: Column, short: int = 24, long: int = 12, limit: int = 40) -> Column:
    """G-23: the batch of an item; texts that are long on average go in smaller batches."""
    return F.floor(position / F.when(mean_length > limit, long).otherwise(short))


def without_later_images(turns: Column) -> Column:
    """P-01: turns array<struct<from, value>>; <image> stays in the first human turn only."""
    first = F.array_position(F.transform(turns, lambda t: t["from"]), "human") - 1

    def clean(t, i):
        later = (t["from"] == "human") & (i > first)
        value = F.regexp_replace(F.regexp_replace(t["value"], "\n*<image>\n*", "\n"), r"^\s+|\s+$", "")
        return F.struct(t["from"].alias("from"), F.when(later, value).otherwise(t["value"]).alias("value"))

    return F.transform(turns, clean)


def media_messages(turns: Column, images: Column, videos: Column) -> Column:
    """P-06 and W-08: struct<messages, error>; a message has a role and content parts struct<type, value>.

    Marks in human turns take the media in order; too few or too many media are an error and give no messages.
    """
    split = r"(?<=<image>|<video>)|(?=<image>|<video>)"

    def pieces(t):
        human = t["from"] == "human"
        parts = F.when(human, F.split(t["value"], split, -1)).otherwise(F.array(t["value"]))
        return F.struct(human.alias("human"), parts.alias("parts"))

    cut = F.transform(turns, pieces)
    empty = F.array().cast("array<struct<role:string,content:array<struct<type:string,value:string>>>>")

    def step(acc, t):
        def part(a, p):
            image, video = t.human & (p == "<image>"), t.human & (p == "<video>")
            k = F.when(image, a.images).when(video, a.videos)
            media = F.when(image, F.get(images, a.images)).otherwise(F.get(videos, a.videos))
            text = F.when(t.human, F.regexp_replace(p, r"^\s+|\s+$", "")).otherwise(p)
            added = F.when(k.isNotNull(), F.array(F.struct(F.when(image, "image").otherwise("video").alias("type"), media.alias("value")))).when(~t.human | (text != ""), F.array(F.struct(F.lit("text").alias("type"), text.alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
            return F.struct((a.images + image.cast("int")).alias("images"), (a.videos + video.cast("int")).alias("videos"), F.concat(a.content, added).alias("content"))

        start = F.struct(acc.images.alias("images"), acc.videos.alias("videos"), F.array().cast("array<struct<type:string,value:string>>").alias("content"))
        done = F.aggregate(t.parts, start, part)
        message = F.struct(F.when(t.human, "user").otherwise("assistant").alias("role"), done.content.alias("content"))
        return F.struct(done.images.alias("images"), done.videos.alias("videos"), F.concat(acc.messages, F.array(message)).alias("messages"))

    out = F.aggregate(cut, F.struct(F.lit(0).alias("images"), F.lit(0).alias("videos"), empty.alias("messages")), step)
    n_images, n_videos = F.coalesce(F.size(images), F.lit(0)), F.coalesce(F.size(videos), F.lit(0))
    error = F.when((out.images > n_images) | (out.videos > n_videos), "more marks than media").when((out.images < n_images) | (out.videos < n_videos), "unused media")
    return F.struct(F.when(error.isNull(), out.messages).alias("messages"), error.alias("error"))

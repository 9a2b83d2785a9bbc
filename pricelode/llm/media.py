"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import webp
from .common import small_batches, table

WIDTH = 16
#: Rows of one image; a longer payload becomes several images, one after the other.
MOST_ROWS = 128
BLOCK = 4 * WIDTH
#: Rows of one batch: images are decoded side by side, which pays the more the wider.
BATCH_ROWS = 1024
#: Images whose two next pixels stood before at this share of places or more are looked at for tools that save.
LEAST_REPEATED = 3 / 32


def payload_images(payload):
    """uint32 images of a payload whose length is a positive multiple of 64; four bytes are one pixel, blue first."""
    pixels = np.frombuffer(payload, dtype="<u4").astype(np.uint32).reshape(-1, WIDTH)
    return [pixels[k : k + MOST_ROWS] for k in range(0, len(pixels), MOST_ROWS)]


def images_payload(images):
    return b"".join(image.astype("<u4").tobytes() for image in images)


def pick_tools(image):
    """Encoder tools that pay: a palette for few colours, copies where much repeats."""
    flat = image.ravel()
    ordered = np.sort(flat)
    colours = 1 + np.count_nonzero(ordered[1:] != ordered[:-1])
    if colours <= 256 and 4 * colours < len(flat):
        return {"palette": True, "copies": True, "cache_bits": 0}
    copies = webp.find_copies(flat)
    if 8 * sum(n for _, n, _ in copies) >= len(flat):
        return {"copies": copies, "cache_bits": 6}
    return {}


def encode_payloads(payloads):
    """Each payload's WebP files, one after the other."""
    images = [payload_images(p) for p in payloads]
    flat = [i for some in images for i in some]
    contents = [None] * len(flat)
    plain = []
    for k, share in enumerate(webp.repeated_shares(flat) if flat else ()):
        if share >= LEAST_REPEATED or len(set(flat[k].tobytes())) < 3:
            tools = pick_tools(flat[k])
            if tools or len(set(flat[k].tobytes())) < 3:
                contents[k] = webp.encode_vp8l(flat[k], **tools)
                continue
        plain.append(k)
    for k, content in zip(plain, webp.encode_plain([flat[k] for k in plain]) if plain else (), strict=True):
        contents[k] = content
    files = iter(map(webp.as_webp, contents))
    return [b"".join(next(files) for _ in some) for some in images]


def decode_media(media):
    """The images of each medium; None for None."""
    contents = [None if m is None else webp.webp_contents(bytes(m)) for m in media]
    pixels = iter(webp.decode_many([c for some in contents if some for c in some]))
    return [None if some is None else [next(pixels) for _ in some] for some in contents]


def _in_parts(sizes, most=2_000_000):
    """Slices of a batch whose sizes sum to most or less, or hold one item."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def store_texts(docs, id_col="doc_id", text_col="text"):
    """Per row: id, n_bytes, media (concatenated WebP files of the UTF-8 bytes, padded with 0 to a positive multiple of 64).

    A null or empty text is one block of zeros. Repeated rows are stored alike;
    an empty table gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession, BATCH_ROWS)

    def run(batches):
        for batch in batches:
            texts = [(text or "").encode() for text in batch["text"]]
            sizes, media = [len(data) for data in texts], []
            for part in _in_parts(sizes):
                media += encode_payloads([data + bytes(-len(data) % BLOCK) or bytes(BLOCK) for data in texts[part]])
            yield pd.DataFrame({"id": batch["id"], "n_bytes": np.array(sizes, dtype=np.int64), "media": media})

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"id {kind}, n_bytes long, media binary")


def _feature(images):
    flat = np.concatenate([i.ravel() for i in images])
    means = ",".join(str(int(np.sum((flat >> np.uint32(s)) & np.uint32(255))) // len(flat)) for s in (24, 16, 8, 0))
    return f"{len(images)} images, {len(flat)} pixels, means {means}"


def read_media(stored):
    """Decode the column media: every column of stored, payload (the pixel arrays' bytes) and feature.

    A null medium gives a null payload and feature. Columns of stored that are
    named payload or feature make way for the results. Repeated rows give
    repeated results, an empty table an empty one; what is no lossless WebP
    file raises ValueError.
    """
    stored = stored.drop("payload", "feature")
    small_batches(stored.sparkSession, BATCH_ROWS)

    def run(batches):
        for batch in batches:
            media, payloads, features = batch["media"].tolist(), [], []
            for part in _in_parts([2 * len(m or b"") for m in media]):
                for images in decode_media(media[part]):
                    payloads.append(None if images is None else images_payload(images))
                    features.append(None if images is None else _feature(images))
            yield batch.assign(payload=payloads, feature=features)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.mapInPandas(run, f"{fields}, payload binary, feature string")


def op10_lossless_webp(spark, sf_dir):
    read = read_media(store_texts(table(spark, sf_dir, "documents")))
    return read.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

"""Codecs applied to the texts of the tables; the round trip must give the text back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType

from . import audio, bits, deflate


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@F.pandas_udf(StringType())
def _ciphered(text: pd.Series) -> pd.Series:
    return text.map(lambda t: bits.decipher(bits.encipher(t.encode())).decode() if t is not None else None)


@F.pandas_udf(BinaryType())
def _packed(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        units = bits.text_units(t)
        if not units:
            return b""
        code, out = bits.PrefixCode.of(units), bits.BitWriter()
        for u in units:
            code.encode(u, out)
        packed = bits.BitReader(out.data())
        assert [code.decode(packed) for _ in units] == units
        return out.data()

    return text.map(one)


@F.pandas_udf(StructType().add("n", IntegerType()).add("peak", IntegerType()))
def _sound(text: pd.Series) -> pd.DataFrame:
    samples = text.fillna("").map(lambda t: audio.adpcm_decode(t.encode()))
    return pd.DataFrame({"n": samples.map(len), "peak": samples.map(lambda x: int(abs(x.astype(int)).max()) if len(x) else 0)})


@F.pandas_udf(StringType())
def _inflated(text: pd.Series) -> pd.Series:
    def one(t):
        data = t.encode()
        return b"".join(deflate.inflate(pack(data[k : k + 8192])) for k in range(0, len(data), 8192)).decode()

    def pack(part: bytes) -> bytes:
        # blocks of all three kinds: fixed ones where all bytes have a code in it, mostly dynamic ones
        if len(part) % 3 == 0:
            try:
                return deflate.deflate_fixed(part)
            except ValueError:
                pass
        return deflate.deflate_dynamic(part)

    return text.map(lambda t: None if t is None else one(t))


QUERIES = {
    "xor_stream": (lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(_ciphered("text")).alias("digest")), "SELECT doc_id, md5(text) AS digest FROM documents"),
    "huffman": (lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", F.octet_length(_packed("text")).alias("n_bytes")), None),
    "adpcm": (lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", _sound("text").alias("x")).select("conv_id", "turn", "x.n", "x.peak"), None),
    "inflate": (lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(_inflated("text")).alias("digest")), "SELECT doc_id, md5(text) AS digest FROM documents"),
}

"""The two wide tables of a property graph. Every field may be null; a row fills those its type uses."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType


def _fields(spec: str) -> StructType:
    kinds = {"s": StringType(), "b": BooleanType(), "d": DoubleType(), "i": IntegerType()}
    return StructType([StructField(n, kinds[k], True) for n, k in (x.split(":") for x in spec.split())])


VERTEX = _fields(
    "id:s type:s name:s visibility:s category:s manufacturer:s status:s in_use:b format:s role:s field:s value:d tier:s "
    "url:s http:s doc_type:s version:s attested:s rows:s midi_in_ch:s midi_out_ch:s midi_thru_pass:b midi_status:s "
    "midi_confirmed:s facet:s alt:s"
)
EDGE = _fields(
    "src:s dst:s rel:s visibility:s setup:s medium:s from_port:s to_port:s status:s confirmed:s value:d line:s "
    "swappable:b bidirectional:b position:i row:s row_index:i http:s note:s label:s"
)
EVIDENCE = "item string, source_ix int, tier string, url string, http string, field string, value int, line string"

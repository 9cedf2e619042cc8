"""Typed access to SAM tags and VCF INFO entries, both kept as MAP<STRING,STRING>."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# VCF header types and their Spark types.
VCF_TYPES = {"Integer": "int", "Float": "double", "String": "string", "Character": "string"}


def tag(tags: Column, key: str, data_type: str = "string") -> Column:
    """Value of an optional SAM field. Tags are stored as ``type:value`` so that they can be written back."""
    return F.substring_index(F.try_element_at(tags, F.lit(key)), ":", -1).try_cast(data_type) \
        if data_type != "string" else F.regexp_replace(F.try_element_at(tags, F.lit(key)), "^[^:]:", "")


def info_value(info: Column, key: str, vcf_type: str = "String", first: bool = True) -> Column:
    """INFO entry with the type its header declares. A Flag is true when present and null otherwise.

    Lists give their first element, or the whole typed array with ``first=False``.
    """
    if vcf_type == "Flag":
        return F.when(F.map_contains_key(info, key), F.lit(True))
    raw = F.try_element_at(info, F.lit(key))
    spark_type = VCF_TYPES[vcf_type]
    if first:
        return F.substring_index(raw, ",", 1).try_cast(spark_type)
    return F.transform(F.split(raw, ","), lambda v: v.try_cast(spark_type))

"""Classification of the whole catalogue: type tags, then all group files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.operators import catalogue as C
from skyframe.session import materialize


def classify(
    records: DataFrame, objects: DataFrame, elements: DataFrame, stored_tags: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(objects after, new elements, new tags, rejected records) for every group.

    The group is a column, so the 33 groups are one job rather than a loop. An
    object created by any group can be tagged by every group that lists it.
    Only groups of the rule table take part. Records of theirs that lack a required
    field are the last frame: nothing is dropped unseen. The records are written once,
    as objects, elements and tags are all mapped from them.
    """
    known = materialize(records.filter(F.col("group").isin(*K.GROUP_TAGS)), "records")
    complete, rejected = C.split_complete(known)
    after = C.upsert_gp(objects, C.gp_objects(complete))
    mapped, _ = C.attach_objects(C.gp_elements(complete), after)
    fresh = C.new_elements(mapped.drop("norad_cat_id"), elements)
    wanted = C.type_tags(objects).unionByName(C.group_tags(complete, after))
    return after, fresh, C.new_tags(wanted, stored_tags), rejected


def classification_report(objects: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct tagged objects, and objects with current elements."""
    return C.tagged_objects(tags).withColumn(
        "objects_with_elements", objects.agg(F.count_if("has_current_elements")).scalar()
    )

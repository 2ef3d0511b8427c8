"""Which landing file becomes which table."""

from __future__ import annotations

from dataclasses import dataclass

# Parts dropped from a landing file name to get the table name.
FILE_NAME_NOISE = (".csv", "olist_", "_dataset")


@dataclass(frozen=True)
class Landing:
    """``multi_line``: quoted values may hold line breaks. Such a file is read by one task, so the flag is
    set only for the table with free text; all other files are split."""

    table: str
    source_type: str
    layer: str
    table_type: str
    unique_key: tuple[str, ...] = ()
    multi_line: bool = False


# The registered tables.
REGISTRY: dict[str, Landing] = {
    entry.table: entry
    for entry in (
        Landing("customers", "google_sheets", "bronze", "dimension", ("customer_id",)),
        Landing("geolocation", "kaggle", "reference", "reference"),
        Landing("products", "google_sheets", "bronze", "dimension", ("product_id",)),
        Landing("sellers", "google_sheets", "bronze", "dimension", ("seller_id",)),
        Landing(
            "product_category_name_translation", "kaggle", "reference", "reference", ("product_category_name",)
        ),
        Landing("order_items", "google_sheets", "bronze", "fact", ("order_id", "order_item_id")),
        Landing("order_payments", "google_sheets", "bronze", "fact", ("order_id", "payment_sequential")),
        # The silver key; review_id alone repeats in the data.
        Landing("order_reviews", "google_sheets", "bronze", "fact", ("review_id", "order_id"), multi_line=True),
        Landing("orders", "google_sheets", "bronze", "fact", ("order_id",)),
        Landing("geography_master", "local_seed", "master", "reference"),
        Landing("product_category_mapping", "local_seed", "reference", "reference"),
    )
}


def target_layer(table: str) -> str:
    if table not in REGISTRY:
        raise ValueError(f"table {table} is not registered")
    return REGISTRY[table].layer

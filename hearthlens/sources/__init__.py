from hearthlens.sources.readers import (read_csv, read_csv_named, read_describe_means, read_gbk_csv,
                                        read_json_log, read_per_city, read_per_city_files,
                                        read_strict_numeric, read_tsv_log)
from hearthlens.sources.jsonpages import broken_pages, flatten_structs, item_shapes, json_items, json_items_of_any_shape, undeclared_fields, union_all_columns
from hearthlens.sources.writers import pending, write_gbk_csv, write_merged, write_name_line, write_per_city

__all__ = [
    "read_csv", "read_csv_named", "read_describe_means", "read_gbk_csv", "read_json_log", "read_per_city",
    "read_per_city_files", "read_strict_numeric", "read_tsv_log", "broken_pages", "flatten_structs", "item_shapes", "json_items", "json_items_of_any_shape", "undeclared_fields",
    "union_all_columns", "pending", "write_gbk_csv", "write_merged", "write_name_line", "write_per_city",
]

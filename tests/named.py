"""Names that several test modules share: the small tram database."""

SF_SMALL = "/root/testdata/sf0.001"

TRAM_CATALOG = {
    "db_id": "trams",
    "table_names_original": ["depot", "tram car", "line"],
    "column_names_original": [["-1", "*"], ["0", "no"], ["0", "district"], ["1", "fleet_no"], ["1", "seats"], ["1", "built"],
                              ["1", "depot_no"], ["2", "line_no"], ["2", "fleet_no"]],
    "column_types": ["text", "number", "text", "number", "number", "time", "number", "number", "number"],
    "primary_keys": [1, 3],
    "foreign_keys": [[6, 1], [8, 3]],
}
TRAM_EXAMPLES = [
    ("trams", "List the districts that have a depot.", "SELECT district FROM depot ORDER BY district"),
    ("trams", "What is the largest number of seats?", "SELECT max(seats) FROM car"),
    ("trams", "How many cars does each district house?",
     "SELECT d.district, count(c.fleet_no) FROM depot d JOIN car c ON c.depot_no = d.no GROUP BY d.district"),
]
TRAM_ROWS = {
    "depot": ([(1, "Harbour"), (2, "Old Town"), (3, "Fields")], "no long, district string"),
    "car": ([(101, 56, 1), (102, 56, 2), (117, 72, 2), (118, 64, 2), (230, None, None)], "fleet_no long, seats long, depot_no long"),
}

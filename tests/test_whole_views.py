"""Queries of algorithms take every row of their view."""

import pytest

from mapsmith.plans import catalog
from mapsmith.plans.views import view

SF = "/root/testdata/sf0.001"
VIEWS = {
    "A2_building_areas": "rects", "A3_buildings": "rects", "A4_cliffs": "edges", "A5_conservation_areas": "rects", "A6_contours": "edges", "A7_fences": "edges", "A9_landcover": "rects",
    "A10_polygons_to_points": "rects", "A11_power_lines": "edges", "A12_railroads": "edges", "A14_shared_paths": "edges", "A16_water_areas": "rects", "A17_watercourse_areas": "rects",
}


class Echo:
    """Stands for an algorithm: gives back what it is given."""

    def __init__(self, **parameters):
        pass

    def execute(self, data, references):
        return data


@pytest.mark.parametrize("name", VIEWS)
def test_an_algorithm_is_given_all_rows(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "ALGORITHMS", dict.fromkeys(catalog.ALGORITHMS, Echo))
    assert catalog.QUERIES[name](spark, SF).count() == view(spark, SF, VIEWS[name]).count()

"""The public algorithms, by command name."""

from mapsmith.algorithms import areas, lines

ALGORITHMS = {
    "building_areas": areas.GeneralizeBuildingAreas, "buildings": areas.GeneralizeBuildings, "cliffs": lines.GeneralizeCliffs,
    "conservation_areas": areas.GeneralizeConservationAreas, "contours": lines.GeneralizeContours, "dissolve_polygons": areas.DissolvePolygons,
    "fences": lines.GeneralizeFences, "keep_intersection": areas.KeepIntersection, "landcover": areas.GeneralizeLandcover,
    "points": lines.GeneralizePoints, "polygons_to_points": areas.GeneralizePolygonsToPoints, "power_lines": lines.GeneralizePowerLines,
    "railroads": lines.GeneralizeRailroads, "remove_overlap": areas.RemoveOverlap, "roads": lines.GeneralizeRoads,
    "shared_paths": lines.GeneralizeSharedPaths, "slope_lines": lines.GeneralizeSlopeLines, "water_areas": areas.GeneralizeWaterAreas,
    "watercourse_areas": areas.GeneralizeWaterCourseAreas,
}

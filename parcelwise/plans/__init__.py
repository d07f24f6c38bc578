"""Reports: functions from tables and explicit parameters to a DataFrame."""

from .brokers import broker_rank_towns, firm_rank_counties, firm_rank_zones
from .counties import CountyScope, county_all, county_class, county_level, price_range_county
from .geographies import custom_geo, municipality_level, towns_communities
from .inventory import area_inventory, county_inventory
from .market_areas import AreaRules, market_area, price_range_area, supply_demand
from .market_share import share_by_company, share_by_price_range
from .views import area_yoy, firm_blocks, firm_display, firm_lines, price_point_yoy

__all__ = [
    "AreaRules",
    "CountyScope",
    "area_inventory",
    "area_yoy",
    "broker_rank_towns",
    "county_all",
    "county_class",
    "county_inventory",
    "county_level",
    "custom_geo",
    "firm_blocks",
    "firm_display",
    "firm_lines",
    "firm_rank_counties",
    "firm_rank_zones",
    "market_area",
    "municipality_level",
    "price_point_yoy",
    "price_range_area",
    "price_range_county",
    "share_by_company",
    "share_by_price_range",
    "supply_demand",
    "towns_communities",
]

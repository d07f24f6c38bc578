"""Column names and types of the input tables.

Each schema maps a library column to the column of the listing database it comes from.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
DATE, TIMESTAMP, MONEY = T.DateType(), T.TimestampType(), T.DecimalType(18, 2)

# library column: (source column, type)
TABLES: dict[str, dict[str, tuple[str, T.DataType]]] = {
    "listings": {
        "listing_key": ("ListingKey", STRING),
        "source_system_id": ("SourceSystemID", INT),
        "standard_status": ("StandardStatus", STRING),
        "property_type": ("PropertyType", STRING),
        "property_sub_type": ("PropertySubType", STRING),
        "list_date": ("ListingContractDate", DATE),
        "close_date": ("CloseDate", DATE),
        "status_date": ("StatusChangeTimestamp", TIMESTAMP),
        "list_price": ("ListPrice", MONEY),
        "close_price": ("ClosePrice", MONEY),
        "building_area": ("BuildingAreaTotal", T.DecimalType(18, 2)),
    },
    "listings_geo": {
        "listing_key": ("ListingKey", STRING),
        "source_system_id": ("SourceSystemID", INT),
        "county_fp": ("CountyFP", INT),
        "state_fp": ("StateFP", INT),
        "municipality": ("Municipality", STRING),
        "municipality_type": ("MunicipalityType", STRING),
        "census_place": ("CensusPlace", STRING),
    },
    "area_listings": {
        "listing_key": ("ListingKey", STRING),
        "source_system_id": ("SourceSystemID", INT),
        "list_date": ("ListingContractDate", DATE),
        "close_date": ("CloseDate", DATE),
        "area": ("area", STRING),
        "subdivision": ("Subdivision", STRING),
        "county_or_parish": ("CountyOrParrish", STRING),
    },
    "county_names": {
        "county_fp": ("CountyFP", INT),
        "state_num": ("State_Num", INT),
        "county_name": ("County_name", STRING),
        "county": ("County", STRING),
    },
    "county_by_region": {
        "region": ("Region", STRING),
        "county": ("County", STRING),
    },
    "listing_sides": {
        "listing_key": ("ListingKey", STRING),
        "source_system_id": ("sourcesystemid", INT),
        "office_key": ("Office_key", STRING),
        "close_date": ("CloseDate", DATE),
        "list_price": ("ListPrice", MONEY),
        "close_price": ("ClosePrice", MONEY),
        "property_type": ("propertytype", STRING),
        "sides": ("sides", T.DecimalType(9, 2)),
        "volume_credit": ("volume_credit", MONEY),
    },
    "offices": {
        "office_key": ("OfficeKey", STRING),
        "office_name": ("OfficeName", STRING),
    },
    "listings_custom_geo": {
        "listing_key": ("ListingKey", STRING),
        "source_system_id": ("SSID", INT),
        "custom_geo": ("custom_geo", STRING),
        "lakefront_flag": ("LakefrontFlag", INT),
    },
    "broker_listings": {
        "list_office_key": ("listagentofficekey", STRING),
        "buyer_office_key": ("BuyerOfficeKey", STRING),
        "list_date": ("ListingContractDate", DATE),
        "contract_date": ("PurchaseContractDate", DATE),
        "close_date": ("CloseDate", DATE),
        "list_price": ("ListPrice", MONEY),
        "close_price": ("ClosePrice", MONEY),
        "town": ("Town", STRING),
        "county_or_parish": ("CountyOrParrish", STRING),
        "zone": ("Zone", STRING),
    },
    "broker_offices": {
        "office_key": ("officekey", STRING),
        "office_name": ("OfficeName", STRING),
        "company": ("Company", STRING),
        "office_mls_id": ("officemlsid", STRING),
        "office_city": ("OfficeCity", STRING),
    },
    "custom_tabs": {
        "tab_name": ("TabName", STRING),
        "tab_type": ("TabType", STRING),
        "tab_header": ("TabHeader", STRING),
        "service_area": ("ServiceArea", STRING),
    },
    "property_subtypes": {
        "property_sub_type": ("PropertySubtype", STRING),
    },
}


def source_schema(table: str) -> T.StructType:
    """Schema of a table under its source column names."""
    return T.StructType(
        [T.StructField(name, kind) for name, kind in TABLES[table].values()]
    )

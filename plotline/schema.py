"""Canonical transaction schema and source schemas."""

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(spec: str) -> T.StructType:
    kinds = {"s": _S, "d": _D, "i": _I, "l": _L}
    return T.StructType(
        [T.StructField(n, kinds[k]) for n, k in (p.split(":") for p in spec.split())]
    )


TRANSACTION = _struct(
    "id:l raw_district:s transaction_type:s address:s land_area:d urban_zone:s non_urban_zone:s "
    "non_urban_use:s transaction_date:s transaction_count:s floor_level:s total_floors:s "
    "building_type:s main_use:s main_material:s build_date:s building_area:d rooms:i halls:i "
    "bathrooms:i partitioned:s has_management:s total_price:l unit_price:d parking_type:s "
    "parking_area:d parking_price:l note:s serial_no:s main_area:d attached_area:d balcony_area:d "
    "elevator:s transfer_no:s county_city:s district:s village:s street:s lane:s alley:s number:s "
    "floor:s sub_number:s community_name:s lat:d lng:d dedup_key:s"
)
TRANSACTION_COLUMNS = TRANSACTION.fieldNames()

# The registry file: 33 columns, known by position.
REGISTRY_COLUMNS = (
    "raw_district transaction_type address land_area urban_zone non_urban_zone non_urban_use "
    "transaction_date transaction_count floor_level total_floors building_type main_use "
    "main_material build_date building_area rooms halls bathrooms partitioned has_management "
    "total_price unit_price parking_type parking_area parking_price note serial_no main_area "
    "attached_area balcony_area elevator transfer_no"
).split()

# Header names (Chinese and English) -> canonical column, for files with a header row.
HEADER_ALIASES = {
    "鄉鎮市區": "raw_district", "交易標的": "transaction_type",
    "土地位置建物門牌": "address", "地址": "address", "門牌": "address",
    "土地移轉總面積平方公尺": "land_area", "土地面積": "land_area",
    "都市土地使用分區": "urban_zone", "非都市土地使用分區": "non_urban_zone",
    "非都市土地使用編定": "non_urban_use",
    "交易年月日": "transaction_date", "交易日期": "transaction_date",
    "交易筆棟數": "transaction_count",
    "移轉層次": "floor_level", "總樓層數": "total_floors",
    "建物型態": "building_type", "主要用途": "main_use",
    "主要建材": "main_material", "建築完成年月": "build_date",
    "建物移轉總面積平方公尺": "building_area", "建物面積": "building_area",
    "建物現況格局-房": "rooms", "房": "rooms",
    "建物現況格局-廳": "halls", "廳": "halls",
    "建物現況格局-衛": "bathrooms", "衛": "bathrooms",
    "建物現況格局-隔間": "partitioned", "有無管理組織": "has_management",
    "總價元": "total_price", "總價": "total_price",
    "單價元平方公尺": "unit_price", "單價": "unit_price",
    "車位類別": "parking_type",
    "車位移轉總面積(平方公尺)": "parking_area", "車位面積": "parking_area",
    "車位總價元": "parking_price", "車位總價": "parking_price",
    "備註": "note", "編號": "serial_no",
    "主建物面積": "main_area", "附屬建物面積": "attached_area",
    "陽台面積": "balcony_area", "電梯": "elevator", "移轉編號": "transfer_no",
    "縣市": "county_city", "區": "district", "社區": "community_name",
    "緯度": "lat", "經度": "lng",
    "address": "address", "total_price": "total_price",
    "unit_price": "unit_price", "transaction_date": "transaction_date",
    "district": "district", "county_city": "county_city",
    "community": "community_name", "lat": "lat", "lng": "lng", "lon": "lng",
}

DOUBLE_COLUMNS = [f.name for f in TRANSACTION if f.dataType == _D]
INT_COLUMNS = [f.name for f in TRANSACTION if f.dataType in (_I, _L) and f.name != "id"]
PART_COLUMNS = (
    "county_city district village street lane alley number floor sub_number".split()
)

# Raw API rows; every measure is text.
API_ROW = _struct(
    "id:l city:s town:s address:s build_type:s community:s date_str:s floor:s area:s "
    "total_price:s unit_price:s lat:d lon:d sq:s raw_json:s"
)
API_JSON = T.StructType(
    [T.StructField(n, _S) for n in "t f j k l m pu AA11 b note tp p cp s".split()]
    + [T.StructField("lat", _D), T.StructField("lon", _D)]
)

# Fields a later duplicate may fill in, by the rule that says "empty".
FILLABLE = {
    "lat": "number", "lng": "number", "community_name": "text", "county_city": "text",
    "building_type": "text", "main_use": "text", "main_material": "text",
    "has_management": "text", "rooms": "null", "halls": "null", "bathrooms": "null",
    "building_area": "number", "unit_price": "number", "transaction_type": "text",
    "floor_level": "text", "total_floors": "text", "note": "text", "land_area": "number",
    "urban_zone": "text", "parking_type": "text", "parking_area": "number",
    "parking_price": "number", "main_area": "number", "attached_area": "number",
    "balcony_area": "number", "elevator": "text",
}

POINT_FILE = _struct("lat:s lng:s city:s district:s street:s housenumber:s")
GEOCODE_CACHE = _struct("address_key:s lat:d lng:d level:s source:s raw_address:s created_at:s")
MANUAL_HEADER = {"地址": "address", "社區名稱": "community_name", "鄉鎮市區": "district", "備註": "remark"}

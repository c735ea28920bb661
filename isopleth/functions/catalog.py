"""Classification of catalog entries: portals, phases, regions, zones, failures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from isopleth.functions.texts import any_in, url_host, url_path
from isopleth.operators.relate import in_boxes, suffix_match

# Portal domains and the portals they belong to; the first that matches counts.
PORTALS = [
    ("cds.climate.copernicus.eu", "CDS"), ("climate.copernicus.eu", "CDS"), ("esgf-node.llnl.gov", "ESGF"), ("pcmdi.llnl.gov", "ESGF"), ("esgf-data.dkrz.de", "ESGF"),
    ("psl.noaa.gov", "NOAA"), ("www.ncei.noaa.gov", "NOAA"), ("disc.gsfc.nasa.gov", "NASA"), ("earthdata.nasa.gov", "NASA"), ("podaac.jpl.nasa.gov", "NASA"), ("gpm.nasa.gov", "NASA"),
    ("rda.ucar.edu", "NCAR"), ("publitheque.meteo.fr", "METEO"), ("donneespubliques.meteofrance.fr", "METEO"), ("ogimet.com", "WMO"), ("cost-g.org", "PORTAL"), ("land.copernicus.eu", "CDS"),
    ("mareografico.it", "PORTAL"), ("scia.isprambiente.it", "PORTAL"), ("meteo.data.gouv.fr", "PORTAL"), ("meteo.gr", "PORTAL"), ("esgf-node.ipsl.upmc.fr", "ESGF"), ("ecmwf.int", "CDS"), ("www.ecmwf.int", "CDS"),
    ("gmao.gsfc.nasa.gov", "NASA"), ("asdc.larc.nasa.gov", "NASA"), ("jra.kishou.go.jp", "JMA"), ("euro-cordex.net", "ESGF"), ("www.ecad.eu", "ECAD"), ("www.g3p.eu", "PORTAL"), ("www.jpl.nasa.gov", "NASA"),
    ("drought.emergency.copernicus.eu", "CDS"), ("data.marine.copernicus.eu", "MARINE"), ("nrt.cmems-du.eu", "MARINE"), ("my.cmems-du.eu", "MARINE"), ("catalogue.ceda.ac.uk", "CEDA"), ("dap.ceda.ac.uk", "CEDA"),
    ("catalogue.ceh.ac.uk", "EIDC"), ("ads.atmosphere.copernicus.eu", "CDS"),
]

# Datasets whose phase is set by name.
FORCED_PHASES = {
    "ERA5": 3, "ERA5 Land": 3, "ERA5-HEAT": 3, "CERRA": 3, "CAMS": 3, "Aridity Index and Potential Evapotranspiration": 4, "MSWEP": 4, "MSWX-Past": 4, "Hydro-JULES": 3, "TUDES": 4, "Mistral": 4, "Mistral (CINECA)": 4,
    "JRA55": 3, "JRA-55": 3, "NOA-GR": 4, "HWE-DB": 4, "SAFRAN": 4, "Rete Mareografica Italiana": 4, "RMI-ISPRA": 4, "COST-g": 4, "G3P": 4,
}

# Datasets that an adapter finds by name.
ADAPTED = ["ERA5", "ERA5 Land", "ERA5-HEAT", "CERRA", "CAMS", "JRA55", "JRA-55", "Hydro-JULES", "EURO-CORDEX", "MED-CORDEX", "CMIP6", "CMIP6-BCCAQ", "MERRA-2", "MERRA2", "IMERG", "CERES-EBAF", "JPL GRACE"]

# Suffixes of files that can be downloaded as they are.
DIRECT_SUFFIXES = r"\.(nc|nc4|netcdf|grib|grib2|grb|grb2|tif|tiff|geotiff|csv|tsv|hdf|hdf5|h5|he5|zarr|zip|gz|tar)$"

# Regions by parts of a dataset's name; the first that matches counts.
REGIONS = [
    ("euro", "Europe"), ("europe", "Europe"), ("e-obs", "Europe"), ("cerra", "Europe"), ("iberia", "Iberian Peninsula"), ("safran", "France"), ("noa-gr", "Greece"), ("cy-obs", "Cyprus"),
    ("sloclim", "Slovenia"), ("apgd", "Alps"), ("arcis", "Arctic"), ("chirps", "Global (tropics)"), ("med-cordex", "Mediterranean"),
]

# Zones as south, north, west, east; the first that holds a box's centre counts.
ZONES = [
    (35.0, 72.0, -25.0, 45.0, "Europe"), (25.0, 50.0, -130.0, -60.0, "North America"), (55.0, 72.0, -180.0, 180.0, "Arctic / High Latitudes"), (-60.0, -10.0, -80.0, -35.0, "South America"),
    (0.0, 40.0, -20.0, 55.0, "North Africa / Mediterranean"), (10.0, 55.0, 60.0, 150.0, "Asia"), (-50.0, -10.0, 110.0, 180.0, "Oceania / Australia"), (-90.0, 90.0, -180.0, 180.0, "Global"),
]

# The variable that a dataset's download takes for a hazard.
HAZARD_VARIABLES = {
    "reanalysis-era5-single-levels": {
        "Mean surface temperature": "2m_temperature", "Extreme heat": "maximum_2m_temperature_since_previous_post_processing", "Cold spell": "minimum_2m_temperature_since_previous_post_processing",
        "Frost": "minimum_2m_temperature_since_previous_post_processing", "Mean precipitation": "total_precipitation", "Heavy precipitation and pluvial floods": "total_precipitation",
        "Mean wind speed": "10m_u_component_of_wind", "Severe wind storm": "10m_wind_gust_since_previous_post_processing", "Tropical cyclone": "mean_sea_level_pressure", "Permafrost": "soil_temperature_level_1",
        "Relative sea level": "mean_sea_level_pressure", "Radiation at surface": "surface_solar_radiation_downwards",
    },
    "reanalysis-era5-land": {"Mean surface temperature": "2m_temperature", "Extreme heat": "2m_temperature", "Mean precipitation": "total_precipitation", "River flood": "total_precipitation", "Heavy precipitation and pluvial floods": "total_precipitation"},
    "reanalysis-cerra-single-levels": {
        "Mean surface temperature": "2m_temperature", "Extreme heat": "2m_temperature", "Cold spell": "2m_temperature", "Frost": "2m_temperature", "Mean precipitation": "total_precipitation",
        "Heavy precipitation and pluvial floods": "total_precipitation", "Mean wind speed": "10m_wind_speed", "Severe wind storm": "10m_wind_speed", "Radiation at surface": "2m_temperature",
    },
    "cams-global-reanalysis-eac4": {
        "Mean wind speed": "10m_u_component_of_wind", "Severe wind storm": "10m_v_component_of_wind", "Tropical cyclone": "mean_sea_level_pressure", "Sand and dust storm": "dust_aerosol_optical_depth_550nm",
        "Air pollution weather": "particulate_matter_10um", "Atmospheric CO₂ at surface": "total_aerosol_optical_depth_550nm", "Radiation at surface": "total_aerosol_optical_depth_550nm",
    },
}
# The dataset, and its variables, that only forecasts have.
FORECAST_DATASET = "reanalysis-cerra-single-levels"
FORECAST_ONLY = [
    "total_precipitation", "10m_wind_gust_since_previous_post_processing", "maximum_2m_temperature_since_previous_post_processing", "minimum_2m_temperature_since_previous_post_processing",
    "surface_net_short_wave_radiation_flux", "surface_net_long_wave_radiation_flux", "surface_solar_radiation_downwards", "surface_thermal_radiation_downwards",
]


def hazard_variable(dataset: Column, hazard: Column, default: Column) -> Column:
    """The variable to ask a dataset for, by the hazard, else the default."""
    table = F.create_map(*(F.lit(x) for name, pairs in HAZARD_VARIABLES.items() for hazard_name, variable in pairs.items() for x in (f"{name}|{hazard_name}", variable)))
    return F.coalesce(table[F.concat_ws("|", dataset, F.trim(hazard))], default)


def product_type(dataset: Column, variable: Column, default: Column) -> Column:
    """forecast where only forecasts have the variable, else the default."""
    return F.when((dataset == FORECAST_DATASET) & variable.isin(FORECAST_ONLY), "forecast").otherwise(default)


def portal(url: Column) -> Column:
    """The portal that a URL's host belongs to."""
    # a transform of one element reads the host once for all domains
    return F.element_at(F.transform(F.array(url_host(F.trim(url))), lambda host: suffix_match(host, PORTALS)), 1)


def region(name: Column) -> Column:
    low, found = F.lower(name), F.lit(None).cast("string")
    for part, text in reversed(REGIONS):
        found = F.when(low.contains(part), text).otherwise(found)
    return found


def zone(south: Column, north: Column, west: Column, east: Column) -> Column:
    """The zone of a box's centre; a box over most of the globe is global."""
    inside = in_boxes((south + north) / 2, (west + east) / 2, ZONES)
    return F.when((north - south > 150) & (east - west > 300), "Global").otherwise(F.coalesce(inside, F.lit("Global")))


def phase(name: Column, access: Column, link: Column, direct: list[str] = ()) -> Column:
    """1 open download, 2 download after registration, 3 portal with an adapter, 4 by hand. direct: datasets with a known download address."""
    access, link = F.lower(F.trim(F.coalesce(access, F.lit("")))), F.trim(F.coalesce(link, F.lit("")))
    registered = access.contains("registration")
    rules = [
        *((name == dataset, forced) for dataset, forced in FORCED_PHASES.items()),
        (name.isin(*direct) if direct else F.lit(False), 1), (name.isin(*ADAPTED), 3),
        (~link.rlike("^https?://") | link.contains(" or ") | access.contains("contact"), 4), (portal(link).isNotNull(), 3),
        (F.lower(url_path(link)).rlike(DIRECT_SUFFIXES) & ~registered, 1), (registered, 2), (access == "open", 1),
    ]
    found = F.lit(4)
    for condition, value in reversed(rules):
        found = F.when(condition, value).otherwise(found)
    return found


def is_permanent(error: Column) -> Column:
    """Whether trying again cannot help: a client's error but for time-outs and rate limits, HTML for data, no chunks."""
    status = F.regexp_extract(error, r"\b(4\d\d)\b", 1)
    return F.coalesce(((status != "") & ~status.isin("408", "429")) | any_in(F.lower(error), ["html", "0 data chunks"]), F.lit(False))


def error_label(kind: Column, code: Column, host: Column, message: Column) -> Column:
    """A failure in a few words. kind: http, connection, timeout, value or another; a code and a host where they are known."""
    at = F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.lit(" - "), host)).otherwise("")
    remote = F.concat(F.lit(" - "), F.coalesce(F.nullif(host, F.lit("")), F.lit("remote")))
    text, number = F.left(message, F.lit(120)), code.cast("string")
    http = (
        F.when(code.isin(401, 403), F.concat(F.lit("HTTP "), number, F.lit(" (auth required)"), at))
        .when(code == 404, F.concat(F.lit("HTTP 404 (URL dead)"), at)).when(code == 429, F.concat(F.lit("HTTP 429 (rate-limited) - "), F.coalesce(host, F.lit(""))))
        .when(code.between(400, 499), F.concat(F.lit("HTTP "), number, remote)).when(code.between(500, 599), F.concat(F.lit("HTTP "), number, F.lit(" (server error)"), remote))
        .otherwise(F.concat(F.lit("HTTP error: "), text))
    )
    page = (kind == "value") & F.contains(F.lower(message), F.lit("html"))
    return F.when(kind == "http", http).when(kind == "connection", F.concat(F.lit("Network error: "), text)).when(kind == "timeout", F.concat(F.lit("Timeout: "), text)).when(page, "Server returned HTML (likely a portal page, not data)").otherwise(F.left(message, F.lit(200)))

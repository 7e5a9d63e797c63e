"""Physical constants and default axes.  Fixed values."""

R_EARTH = 6.371e6
OMEGA = 7.2921e-5
G0 = 9.81
R_DRY = 287.05
CP_DRY = 1004.0
KAPPA = R_DRY / CP_DRY
R_VAPOUR = 461.5
L_VAPOUR = 2.501e6
SCALE_HEIGHT = 7000.0

LEVELS = (1000, 850, 700, 500, 400, 300, 250, 200, 100)
MEAN_LEVELS = (300, 250, 200)
VARIABLES = ("u", "v", "w", "t", "pv", "z", "q")
LAT_HALF, LON_HALF = 21.0, 36.0
TAPER_LOW, TAPER_HIGH, TAPER_POLAR = 15.0, 25.0, 85.0
F_MIN_LAT = 5.0
"""Latitude below which the Coriolis parameter is held."""

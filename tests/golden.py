"""Published results the series operators must reproduce."""

# Weekly revenue, from the week ending 2009-12-06 on.
FIRST_WEEK = "2009-12-06"
WEEKLY_REVENUE = [
    231188.51, 206940.73, 206912.87, 35543.9, 0.0, 167028.95, 124624.61, 118871.351,
    142587.761, 111487.692, 78671.66, 160418.402, 151246.202, 150514.36, 118047.1, 164051.771,
    171185.68, 118130.62, 123675.76, 140629.381, 137973.62, 169956.751, 148275.83, 155013.54,
    137592.57, 141429.27, 90081.06, 199249.51, 126349.39, 103486.84, 169046.57, 136053.12,
    144064.58, 132878.5, 149044.98, 117052.49, 139305.07, 153984.91, 135882.55, 122576.55,
    118365.94, 154468.921, 222980.04, 301285.66, 241530.44, 296918.04, 219662.67, 195882.45,
    261394.91, 281275.751, 258225.061, 244985.99, 260185.38, 210989.13, 161749.12, 45489.51,
    0.0, 113554.8, 152948.85, 174203.23, 103839.0, 104595.81, 87317.94, 125057.15,
    129652.77, 116491.82, 111795.93, 136539.82, 127478.72, 142061.58, 119060.73, 133959.871,
    115199.4, 72659.06, 122023.37, 177142.32, 194680.79, 145642.61, 100830.37, 192352.12,
    170404.42, 110672.67, 116019.82, 130390.52, 116102.79, 166292.54, 162800.541, 154722.05,
    142536.62, 166648.4, 146243.96, 112693.34, 164657.3, 208050.3, 306021.451, 191844.35,
    293886.99, 201158.44, 252543.95, 233225.54, 256827.44, 261135.17, 271134.62, 244631.57,
    247079.28, 404543.71,
]
HORIZON = 12

# First forecast of the constant models.
FIRST_FORECAST = {
    "Naive": 208050.30,
    "MovingAverage_4": 157911.225,
    "MovingAverage_8": 157294.063875,
    "MovingAverage_12": 148929.848417,
}

# Test errors, published for the naive model, and for the fits as closely as a
# search over a grid can come.
NAIVE_RMSE, NAIVE_WAPE = 76669.12, 22.55
AR_RMSE, SEASONAL_RMSE = 88048.27, 57057.61
SMOOTHING_RMSE = {
    "SES": 160239.2,
    "Holt": 122352.3,
    "HoltWinters_s4": 123684.3,
    "HoltWinters_s13": 112934.6,
}

# Rows per decile and customers per lift line for 556 customers.
DECILE_ROWS = [56, 56, 55, 56, 55, 56, 55, 56, 55, 56]
LIFT_ROWS = [27, 55, 111, 166, 278]

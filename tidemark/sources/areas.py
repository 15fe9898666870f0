"""The built-in named areas: presets and sea areas, as plain rows."""

from __future__ import annotations

#: Fixed values: (name, min_lon, max_lon, min_lat, max_lat) of the presets, in documented order.
PRESETS = [
    ("global", -180.0, 180.0, -90.0, 90.0),
    ("baltic", 8.0, 31.0, 53.0, 66.0),
    ("norway", -10.0, 45.0, 55.0, 85.0),
    ("arctic", -180.0, 180.0, 60.0, 90.0),
    ("atlantic", -83.0, 20.0, -60.0, 70.0),
    ("europe", -25.0, 45.0, 34.0, 72.0),
    ("mediterranean", -6.0, 37.0, 30.0, 46.0),
]

#: Fixed values: (name, min_lon, max_lon, min_lat, max_lat, crosses the antimeridian) of the IHO sea areas, sorted by name.
SEA_AREAS = [
    ("Adriatic Sea", 12.0652, 20.0208, 39.7431, 45.8089, False),
    ("Aegean Sea", 22.5316, 28.3306, 35.1095, 41.0913, False),
    ("Alboran Sea", -5.3538, -1.1883, 35.0707, 36.8415, False),
    ("Andaman or Burma Sea", 92.3904, 99.1397, 5.5343, 17.7539, False),
    ("Arabian Sea", 51.0223, 74.335, -0.7034, 25.5974, False),
    ("Arafura Sea", 130.7588, 142.1993, -18.0068, -2.9027, False),
    ("Arctic Ocean", -180.0, 180.0, 71.3875, 90.0, False),
    ("Baffin Bay", -82.2038, -50.5233, 69.617, 82.4498, False),
    ("Balearic (Iberian Sea)", -0.3659, 4.2902, 38.6473, 41.8748, False),
    ("Bali Sea", 114.3402, 117.1657, -8.9986, -7.0131, False),
    ("Baltic Sea", 9.5223, 23.5117, 52.6535, 59.9386, False),
    ("Banda Sea", 120.4667, 133.1514, -8.8645, -0.8359, False),
    ("Barentsz Sea", 16.5818, 68.5783, 65.8828, 81.8512, False),
    ("Bass Strait", 143.5325, 149.9095, -41.4403, -37.4608, False),
    ("Bay of Bengal", 78.8982, 95.0488, 5.734, 24.3777, False),
    ("Bay of Biscay", -7.8968, -0.1462, 43.2744, 47.9878, False),
    ("Bay of Fundy", -67.324, -63.3047, 44.088, 46.2026, False),
    ("Beaufort Sea", -156.6649, -122.6528, 67.5965, 76.3629, False),
    ("Bering Sea", 161.8238, -156.2257, 51.3508, 66.5629, True),
    ("Bismarck Sea", 141.9929, 152.8765, -5.962, -1.0746, False),
    ("Black Sea", 27.4437, 42.355, 40.9088, 47.3103, False),
    ("Bristol Channel", -4.9243, -2.3454, 50.9889, 51.8189, False),
    ("Caribbean Sea", -89.4129, -59.4216, 7.7098, 22.7065, False),
    ("Celebes Sea", 116.7183, 125.6139, 0.8011, 7.8516, False),
    ("Celtic Sea", -11.5, -4.1381, 46.5006, 52.3957, False),
    ("Ceram Sea", 125.9173, 134.0316, -5.2739, -1.1861, False),
    ("Chukchi Sea", 177.4788, -156.4799, 65.9344, 71.7113, True),
    ("Coral Sea", 141.0216, 169.8654, -30.0, -6.7929, False),
    ("Davis Strait", -70.1432, -44.4618, 59.8915, 70.0721, False),
    ("East Siberian Sea", 139.0318, 180.0, 64.3154, 77.0971, False),
    ("Eastern China Sea", 118.478, 131.1322, 24.0576, 33.372, False),
    ("English Channel", -5.7087, 1.9309, 48.5, 51.166, False),
    ("Flores Sea", 117.1333, 122.9389, -8.744, -5.5076, False),
    ("Great Australian Bight", 117.6142, 146.2312, -43.566, -31.4637, False),
    ("Greenland Sea", -35.9868, 17.4822, 65.007, 82.7807, False),
    ("Gulf of Aden", 42.5135, 51.2867, 10.3781, 15.2197, False),
    ("Gulf of Alaska", -163.3576, -136.6181, 54.2983, 61.5495, False),
    ("Gulf of Aqaba", 34.3273, 35.0014, 27.9001, 29.5495, False),
    ("Gulf of Boni", 120.1888, 121.8667, -5.6156, -2.5805, False),
    ("Gulf of Bothnia", 17.0389, 25.4866, 59.7209, 67.0806, False),
    ("Gulf of California", -115.036, -106.7851, 22.8788, 31.9496, False),
    ("Gulf of Finland", 22.91, 37.4689, 59.2146, 62.9158, False),
    ("Gulf of Guinea", -7.7263, 10.1827, -0.936, 6.6227, False),
    ("Gulf of Mexico", -98.0539, -80.433, 17.4068, 31.4648, False),
    ("Gulf of Oman", 56.268, 61.7825, 22.4749, 25.9434, False),
    ("Gulf of Riga", 21.7251, 24.6168, 56.8046, 59.2148, False),
    ("Gulf of St. Lawrence", -74.8648, -54.7034, 44.9585, 52.2224, False),
    ("Gulf of Suez", 32.3429, 34.2278, 27.45, 30.0682, False),
    ("Gulf of Thailand", 99.1327, 105.3623, 5.3905, 13.7271, False),
    ("Gulf of Tomini", 120.005, 123.4102, -1.4405, 0.5553, False),
    ("Halmahera Sea", 127.5492, 130.9317, -1.681, 2.487, False),
    ("Hudson Bay", -95.3462, -75.8844, 51.1436, 66.0264, False),
    ("Hudson Strait", -80.9516, -64.4322, 55.8448, 64.98, False),
    ("Indian Ocean", 20.0026, 146.8982, -60.0, 10.445, False),
    ("Inner Seas off the West Coast of Scotland", -8.2496, -4.4586, 54.3364, 58.6245, False),
    ("Ionian Sea", 15.0846, 23.2247, 36.409, 40.5207, False),
    ("Irish Sea and St. George's Channel", -6.5691, -2.6392, 51.9041, 55.0042, False),
    ("Japan Sea", 125.8014, 142.2638, 32.575, 51.7473, False),
    ("Java Sea", 104.5271, 119.4894, -7.8109, -1.5494, False),
    ("Kara Sea", 54.9305, 107.6064, 64.4323, 81.2682, False),
    ("Kattegat", 9.3656, 13.0629, 54.6337, 58.0775, False),
    ("Labrador Sea", -64.306, -43.6749, 47.386, 60.3988, False),
    ("Laccadive Sea", 71.9824, 80.5888, -0.6932, 14.7927, False),
    ("Laptev Sea", 93.6572, 141.2251, 63.6878, 81.269, False),
    ("Ligurian Sea", 7.539, 9.8521, 42.8644, 44.4272, False),
    ("Lincoln Sea", -70.1954, -37.0055, 81.4958, 83.5619, False),
    ("Makassar Strait", 115.9545, 120.8283, -5.5956, 1.325, False),
    ("Malacca Strait", 95.4423, 103.5107, 0.8573, 8.454, False),
    ("Mediterranean Sea - Eastern Basin", 10.0158, 36.2157, 30.0681, 37.8015, False),
    ("Mediterranean Sea - Western Basin", -2.1934, 12.4242, 35.5723, 43.924, False),
    ("Molukka Sea", 123.2932, 128.5664, -1.8388, 4.486, False),
    ("Mozambique Channel", 32.4306, 49.242, -26.8424, -10.4989, False),
    ("North Atlantic Ocean", -83.0149, 6.62, -0.0026, 68.6387, False),
    ("North Pacific Ocean", 128.6865, -76.9854, 0.0, 58.2115, True),
    ("North Sea", -4.4454, 12.0059, 50.9954, 61.017, False),
    ("Norwegian Sea", -13.5007, 25.7887, 60.8608, 76.5645, False),
    ("Persian Gulf", 47.7024, 57.34, 23.959, 31.1859, False),
    ("Philippine Sea", 120.1001, 146.0533, 2.4983, 35.2631, False),
    ("Red Sea", 33.6394, 43.5055, 12.4563, 28.1395, False),
    ("Rio de La Plata", -59.7657, -54.943, -36.3589, -31.5234, False),
    ("Savu Sea", 118.5023, 125.0051, -10.9226, -8.214, False),
    ("Sea of Azov", 34.5163, 40.4297, 45.1009, 47.3764, False),
    ("Sea of Marmara", 26.1742, 29.9422, 39.9989, 41.2329, False),
    ("Sea of Okhotsk", 135.1719, 167.1682, 43.2166, 62.9155, False),
    ("Seto Naikai or Inland Sea", 130.8369, 135.6697, 33.1973, 34.8645, False),
    ("Singapore Strait", 103.3457, 104.5826, 1.0717, 1.7004, False),
    ("Skagerrak", 6.9982, 11.9166, 57.0988, 59.9191, False),
    ("Solomon Sea", 146.9454, 162.3484, -11.8825, -4.8333, False),
    ("South Atlantic Ocean", -69.6008, 20.009, -60.0, 0.0751, False),
    ("South China Sea", 102.2385, 122.1513, -3.2287, 25.5673, False),
    ("South Pacific Ocean", 130.1113, -67.2667, -60.0, 3.3911, True),
    ("Southern Ocean", -180.0, 180.0, -85.5625, -60.0, False),
    ("Strait of Gibraltar", -6.0325, -5.2787, 35.776, 36.1869, False),
    ("Sulu Sea", 116.7397, 123.4205, 5.0201, 13.4452, False),
    ("Tasman Sea", 146.8726, 175.287, -50.8669, -30.0, False),
    ("The Coastal Waters of Southeast Alaska and British Columbia", -137.1302, -122.1499, 47.0238, 59.4972, False),
    ("The Northwestern Passages", -128.0056, -69.0901, 63.7574, 81.7018, False),
    ("Timor Sea", 122.8523, 132.9313, -15.796, -8.1828, False),
    ("Tyrrhenian Sea", 8.6485, 16.2231, 37.8015, 44.1095, False),
    ("White Sea", 32.1325, 45.6716, 60.951, 68.6568, False),
    ("Yellow Sea", 117.5162, 127.4589, 33.276, 41.1592, False),
]

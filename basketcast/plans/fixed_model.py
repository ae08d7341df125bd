"""A fixed, written demand model: four trees of depth three, for checks of scoring against SQL.

Fitted once with ``boosting.fit_boosted_trees`` on the smallest daily table; numbers rounded, cuts moved off the
values that features take. The row of tree -1 holds the base.
"""

# Tree, node, feature, cut, yes (below the cut), no, value of a leaf, gain of a split.
NODES = [
    (-1, 0, None, None, None, None, 42.1293, None),
    (0, 0, 'Quantity_RollingMean7', 41.433, 1, 2, None, 1987463.894),
    (0, 1, 'Quantity_RollingMean7', 31.863, 3, 4, None, 271317.948),
    (0, 2, 'Quantity_RollingMean7', 54.573, 5, 6, None, 600637.311),
    (0, 3, 'Quantity_RollingMean7', 28.433, 7, 8, None, 39830.281),
    (0, 4, 'Quantity_RollingMean7', 35.433, 9, 10, None, 43657.429),
    (0, 5, 'Quantity_RollingMean7', 49.573, 11, 12, None, 89756.577),
    (0, 6, 'Quantity_RollingMean7', 68.863, 13, 14, None, 96153.037),
    (0, 7, None, None, None, None, -9.1076, None),
    (0, 8, None, None, None, None, -6.0413, None),
    (0, 9, None, None, None, None, -4.4462, None),
    (0, 10, None, None, None, None, -1.8563, None),
    (0, 11, None, None, None, None, 1.4046, None),
    (0, 12, None, None, None, None, 5.0372, None),
    (0, 13, None, None, None, None, 9.4262, None),
    (0, 14, None, None, None, None, 17.3769, None),
    (1, 0, 'Quantity_RollingMean7', 44.863, 1, 2, None, 513199.041),
    (1, 1, 'Quantity_RollingMean7', 35.863, 3, 4, None, 109884.212),
    (1, 2, 'Quantity_Lag1', 66.003, 5, 6, None, 136461.446),
    (1, 3, 'Quantity_Lag1', 33.003, 7, 8, None, 43381.738),
    (1, 4, 'Quantity_Lag1', 60.003, 9, 10, None, 84685.235),
    (1, 5, 'Quantity_RollingMean7', 60.433, 11, 12, None, 96642.366),
    (1, 6, 'Quantity_RollingMean7', 63.433, 13, 14, None, 74423.997),
    (1, 7, None, None, None, None, -2.2181, None),
    (1, 8, None, None, None, None, -4.716, None),
    (1, 9, None, None, None, None, 0.3382, None),
    (1, 10, None, None, None, None, -3.9359, None),
    (1, 11, None, None, None, None, 3.4882, None),
    (1, 12, None, None, None, None, 9.1587, None),
    (1, 13, None, None, None, None, -1.1858, None),
    (1, 14, None, None, None, None, 5.5878, None),
    (2, 0, 'Quantity_RollingMean7', 50.003, 1, 2, None, 149167.698),
    (2, 1, 'Quantity_RollingMean7', 25.863, 3, 4, None, 53450.542),
    (2, 2, 'Quantity_Lag1', 86.003, 5, 6, None, 61152.938),
    (2, 3, 'Quantity_RollingMean7', 19.433, 7, 8, None, 7304.725),
    (2, 4, 'Quantity_Lag1', 30.003, 9, 10, None, 73344.53),
    (2, 5, 'Quantity_Lag1', 29.003, 11, 12, None, 26462.167),
    (2, 6, 'Quantity_Lag1', 119.003, 13, 14, None, 14997.817),
    (2, 7, None, None, None, None, -6.6006, None),
    (2, 8, None, None, None, None, -3.2637, None),
    (2, 9, None, None, None, None, 0.8298, None),
    (2, 10, None, None, None, None, -1.3304, None),
    (2, 11, None, None, None, None, 5.2751, None),
    (2, 12, None, None, None, None, 2.4303, None),
    (2, 13, None, None, None, None, 0.3715, None),
    (2, 14, None, None, None, None, -3.4523, None),
    (3, 0, 'Quantity_RollingMean7', 39.003, 1, 2, None, 77986.911),
    (3, 1, 'Quantity_Lag1', 46.003, 3, 4, None, 13059.46),
    (3, 2, 'Quantity_Lag1', 35.003, 5, 6, None, 44395.806),
    (3, 3, 'Quantity_RollingMean7', 29.433, 7, 8, None, 12870.172),
    (3, 4, 'Quantity_RollingMean30', 37.103, 9, 10, None, 3768.646),
    (3, 5, 'Quantity_Lag1', 6.003, 11, 12, None, 19554.673),
    (3, 6, 'Quantity_RollingMean7', 56.573, 13, 14, None, 34646.108),
    (3, 7, None, None, None, None, -1.6289, None),
    (3, 8, None, None, None, None, -0.2422, None),
    (3, 9, None, None, None, None, -3.0653, None),
    (3, 10, None, None, None, None, -1.6502, None),
    (3, 11, None, None, None, None, 4.9444, None),
    (3, 12, None, None, None, None, 1.7022, None),
    (3, 13, None, None, None, None, -0.3631, None),
    (3, 14, None, None, None, None, 2.0663, None),
]

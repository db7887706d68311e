"""The order in which a block's coefficients are coded, for one to four axes.

Fixed values of the format: the n-th coefficient in the code is the one at this place of the
block (x fastest). They ascend by total frequency, then by its square sum; the order of
coefficients that are equal in both is part of the format too.
"""

ORDER_1 = (
    0, 1, 2, 3,
)
ORDER_2 = (
    0, 1, 4, 5, 2, 8, 6, 9, 3, 12, 10, 7, 13, 11, 14, 15,
)
ORDER_3 = (
    0, 1, 4, 16, 20, 17, 5, 2, 8, 32, 21, 6, 18, 24, 9, 33, 36, 3, 12, 48, 22, 25, 37, 40, 34, 10, 7, 19, 28,
    13, 49, 52, 41, 38, 26, 23, 29, 53, 11, 35, 44, 14, 50, 56, 42, 27, 39, 45, 30, 54, 57, 60, 51, 15, 43,
    46, 58, 61, 55, 31, 62, 59, 47, 63,
)
ORDER_4 = (
    0, 1, 4, 16, 64, 5, 80, 17, 68, 65, 20, 2, 8, 32, 128, 84, 81, 69, 21, 6, 18, 66, 24, 72, 9, 96, 33, 36,
    129, 132, 144, 3, 12, 48, 192, 85, 82, 70, 22, 73, 25, 88, 37, 100, 97, 148, 145, 133, 10, 160, 34, 136,
    130, 40, 7, 19, 67, 28, 76, 13, 112, 49, 52, 193, 196, 208, 86, 89, 101, 149, 161, 137, 41, 134, 38, 164,
    26, 152, 146, 104, 98, 74, 83, 71, 23, 77, 29, 92, 53, 116, 113, 212, 209, 197, 11, 35, 131, 44, 140, 14,
    176, 50, 56, 194, 200, 224, 90, 165, 102, 153, 150, 105, 168, 162, 138, 42, 87, 93, 117, 213, 27, 75, 99,
    39, 135, 147, 108, 45, 141, 156, 30, 78, 177, 180, 54, 114, 120, 57, 198, 210, 216, 201, 225, 228, 15,
    240, 51, 204, 195, 60, 169, 166, 154, 106, 91, 103, 151, 109, 157, 94, 181, 118, 121, 214, 217, 229, 163,
    139, 43, 142, 46, 172, 58, 184, 178, 232, 226, 202, 241, 205, 61, 199, 55, 244, 31, 220, 211, 124, 115,
    79, 170, 167, 155, 107, 158, 110, 173, 122, 185, 182, 233, 230, 218, 95, 245, 119, 221, 215, 125, 242,
    206, 62, 203, 59, 248, 47, 236, 227, 188, 179, 143, 171, 174, 186, 234, 246, 222, 126, 219, 123, 249, 111,
    237, 231, 189, 183, 159, 252, 243, 207, 63, 175, 250, 187, 238, 235, 190, 253, 247, 223, 127, 254, 251,
    239, 191, 255,
)

ORDERS = {1: ORDER_1, 2: ORDER_2, 3: ORDER_3, 4: ORDER_4}

"""Operators on grids."""

from gridframe.operators.distance import class_distance, distance
from gridframe.operators.draw import cluster, gradient, noise, pattern, tessellation, texture
from gridframe.operators.geometry import add_layers, crop, pad, remove, resize, rotate, select, transpose
from gridframe.operators.measures import adjacency, area, dissimilarity, label, perimeter
from gridframe.operators.pointwise import blend, categorise, mask_filter, offset, permute, perturb, replace_values, scale, value_range
from gridframe.operators.raster import hillshade, rasterise
from gridframe.operators.stencil import dilate, erode, interpolate, match, morph, structure
from gridframe.operators.thinning import skeletonise
from gridframe.operators.zonal import centroid, componentise, fill, nearest_class, summarise

__all__ = [n for n in dir() if n[0] != "_"]

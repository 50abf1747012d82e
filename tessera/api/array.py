"""Constructors of arrays."""

from tessera.operators.matrix import Array

arange, range, linspace, zeros, ones, full, eye, randn, rand_uniform = Array.arange, Array.range, Array.linspace, Array.zeros, Array.ones, Array.full, Array.eye, Array.randn, Array.rand_uniform

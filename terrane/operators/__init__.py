"""Operators over tables of observations, pairs, edges and labels."""

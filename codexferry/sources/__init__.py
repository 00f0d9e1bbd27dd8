"""Readers: archives, export trees and tables as DataFrames."""
